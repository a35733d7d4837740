"""The paged source: pages as they are asked for, cut at the wanted number, filters that the interface answers."""

import json

import pytest

from colophon.sources import paged


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("answers")
    for q, n in ((1, 130), (2, 50), (3, 0), (4, 7)):
        (root / f"query={q}").mkdir()
        works = [{"rank": i, "id": f"W{i}", "title": "" if i % 10 == 3 else f" t{i}", "publication_year": None if i == 5 else 1990 + i % 40, "cited_by_count": i} for i in range(n)]
        for part in range(2):
            (root / f"query={q}" / f"part-{part}.txt").write_text("\n".join(json.dumps(w) for w in works[part::2]))
    (root / "_SUCCESS").write_text("")
    paged.register(spark)
    return str(root)


def load(spark, folder, **options):
    return spark.read.format("paged_works").options(folder=folder, **options).load()


def test_pages_and_limits(spark, folder):
    rows = load(spark, folder, top_k=70).collect()
    first = sorted((r for r in rows if r.query == 1), key=lambda r: r.place)
    assert [r.id for r in first] == [f"W{i}" for i in range(70) if i % 10 != 3] and {r.page for r in first} == {1, 2} and {r.total for r in first} == {130}
    assert sum(r.query == 2 for r in rows) == 45 and sum(r.query == 4 for r in rows) == 6 and not any(r.query == 3 for r in rows)
    assert [r.id for r in sorted(load(spark, folder, top_k=50, start=100).where("query = 1").collect(), key=lambda r: r.place)] == [f"W{i}" for i in range(100, 130) if i % 10 != 3]
    assert load(spark, folder).count() == 117 + 45 + 6


def test_years(spark, folder):
    late = load(spark, folder, top_k=20, year_max=1993).where("query = 1").collect()  # from 1991, as the interface has it
    assert {r.year for r in late} == {1991, 1992} and {r.total for r in late} == {12}  # those of 1993 have no title
    # pages of ten: the third
    assert [r.id for r in sorted(load(spark, folder, top_k=10, start=20).where("query = 1").collect(), key=lambda r: r.place)] == [f"W{i}" for i in range(20, 30) if i != 23]


def test_filters_are_pushed(spark, folder):
    df = load(spark, folder).where("year >= 1995 AND year < 2000 AND cited > 3")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "1995" not in plan and "2000" not in plan and "> 3" in plan  # Spark is left with the filter that the interface cannot take
    rows = df.where("query = 1").collect()
    every = load(spark, folder).where("query = 1").collect()
    assert sorted(r.id for r in rows) == sorted(r.id for r in every if r.year and 1995 <= r.year < 2000 and r.cited > 3)
    assert {r.total for r in rows} == {sum(1995 <= 1990 + i % 40 < 2000 and i != 5 for i in range(130))}  # the interface counted what it was asked for
    # the best 70 are taken before a filter: it must not change which they are
    top = load(spark, folder, top_k=70).where("year >= 2020 AND query = 1").collect()
    assert sorted(r.id for r in top) == sorted(f"W{i}" for i in range(70) if i % 10 != 3 and 1990 + i % 40 >= 2020) and {r.total for r in top} == {130}
