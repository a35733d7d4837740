"""Payload rows, alike titles against all pairs, and an index in a folder."""

import datetime
import difflib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from colophon.functions import payloads as J
from colophon.operators import fuzzy, index
from colophon.plans import source_queries
from colophon.plans.base import ORACLE_SQL
from colophon.sources import works


def test_dirty_works(spark):
    rows = [("not json",), ("{}",), ('{"title": " "}',), ('{"title": "T", "open_access": {"is_oa": false}, "locations": [{"source": null}, {"source": {"display_name": "Neurocomputing"}}], "id": "x"}',), (None,)]
    got = [r.x for r in spark.createDataFrame(rows, "p string").select(works.work_row(F.col("p")).alias("x")).collect()]
    assert got[:3] == [None] * 3 and got[4] is None
    assert (got[3].venue, got[3].access, got[3].doi, got[3].level, got[3].work_id, got[3].authors) == ("Neurocomputing", "closed", None, "C", None, [])


def test_alike_titles_against_all_pairs(spark):
    rng = random.Random(17)
    words = ["deep", "net", "a", "of", "image", "super", "x", "ring"]
    titles = [" ".join(rng.choices(words, k=rng.randrange(0, 5))) for _ in range(120)]
    titles += ["".join(c if rng.random() > 0.15 else rng.choice("aeiou") for c in t).upper() for t in titles[:60]]
    df = spark.createDataFrame(list(enumerate(titles)), "id int, title string")
    got = {(r.target_id, r.cand_id) for r in fuzzy.alike(df.where("id < 90"), df).collect()}
    norm = [re.sub("[^a-z0-9]+", " ", t.lower()).strip() for t in titles]
    want = {(i, j) for i, a in enumerate(norm[:90]) for j, b in enumerate(norm) if a and b and (a in b or b in a or difflib.SequenceMatcher(None, a, b).ratio() > 0.8)}
    assert got == want


def test_index_in_a_folder(spark, tmp_path):
    chunks = spark.createDataFrame([(1, 7, "a"), (2, 7, "b")], "chunk_id int, paper_id int, text string")
    vectors = spark.createDataFrame([(1, [0.5]), (2, [1.0])], "chunk_id int, v array<double>")
    folder = str(tmp_path / "index")
    assert index.load(spark, folder) is None
    index.save(chunks, vectors, folder, paper=7)
    index.append(chunks.withColumn("chunk_id", F.col("chunk_id") + 10), vectors, folder)
    assert [t.count() for t in index.load(spark, folder)] == [4, 4]
    for bad in (chunks.limit(0), chunks.withColumn("paper_id", F.lit(8))):
        with pytest.raises(ValueError):
            index.save(bad, vectors, folder, paper=7)


def test_replies(spark):
    df = spark.createDataFrame([("no array",), ("[]",), ('[{"index": 1}]',), ("```json\n[{\"index\": 3, \"caption\": \"Fig\"}]\n```",)], "t string")
    assert [r.x for r in df.select(J.captions(F.col("t")).alias("x")).collect()][:3] == [None] * 3
    text = spark.createDataFrame([("12\nFigure 3: a\nb\nc.\nbody",), ("body\nmore",), ("7",), ("",), ("Fig 2. no end\nat all",)], "t string")
    assert [r.x for r in text.select(J.without_page_prefix(F.col("t")).alias("x")).collect()] == ["body", "body\nmore", "", "", ""]
    names = spark.createDataFrame([("http://a/b/con.pdf",), ("http://a/",), ("http://a/x y?q=1",), ("http://a/" + "n" * 200 + ".pdf",)], "t string")
    assert [r.x for r in names.select(J.url_file_name(F.col("t")).alias("x")).collect()] == ["paper.pdf", "paper.pdf", "x_y", "n" * 176 + ".pdf"]


def test_files(spark, tmp_path):
    from colophon.sources import files

    for name, text in (("a.txt", "one\ntwo é"), ("b.MD", "# x"), ("c.html", "<h1>T</h1><script>x</script><p>body</p>")):
        (tmp_path / name).write_text(text, encoding="utf-8")
    got = {r.source.rsplit("/", 1)[-1]: r for r in files.load_files(spark, str(tmp_path)).collect()}
    assert got["a.txt"].text == "one\ntwo é" and got["a.txt"].file_size == 10 and got["b.MD"].file_type == "md" and "body" in got["c.html"].text and "<p>" not in got["c.html"].text
    (tmp_path / "d.exe").write_text("x")
    with pytest.raises(Exception, match="cannot read"):
        files.load_files(spark, str(tmp_path)).collect()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.load_texts(spark, str(tmp_path / "none")).collect()


def test_unicode(spark):
    from colophon.functions import unicode as U

    df = spark.createDataFrame([("ﬁne Ｔext①",), ("Straße",), (None,)], "t string")
    assert [tuple(r) for r in df.select(U.nfkc(F.col("t")), U.match_key(F.col("t"))).collect()] == [("fine Text1", "finetext1"), ("Straße", "strasse"), (None, None)]


def test_cache_hits_by_the_microsecond(spark, tmp_path):
    """Stored results last half an hour to the fraction of a second, in the query and in its SQL."""
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    times = {1: (0.9, 1800.95), 2: (0.4, 1800.6), 3: (0.4, 1800.4), 4: (0.6, 1800.5), 5: (0.4, 1800.6, 3600.5)}
    rows = [(10 * user + i, user, at(s)) for user, of in times.items() for i, s in enumerate(of)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz").write.parquet(f"{tmp_path}/events.parquet")
    want = [(1, 2, 0), (2, 2, 0), (3, 2, 1), (4, 2, 1), (5, 3, 1)]
    assert sorted(map(tuple, source_queries.cache_hits(spark, str(tmp_path)).collect())) == want
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert sorted(db.execute(ORACLE_SQL["cache_hits"]).fetchall()) == want
