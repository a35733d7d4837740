"""Heavy sets, stars of near copies and split lists against brute force."""

import random

import pytest

from colophon.llm import jaccard_join

from .test_edges import brute_components


def near_copies(rng, n, length, edits):
    base = [f"w{rng.randrange(5000)}" for _ in range(length)]
    out = []
    for _ in range(n):
        text = list(base)
        for _ in range(rng.randrange(edits)):
            text[rng.randrange(length)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(text))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    texts = []
    for n, length, edits in ((60, 120, 6), (40, 300, 14), (30, 60, 4), (5, 40, 3), (2, 200, 2), (2, 33, 2)):
        texts += near_copies(rng, n, length, edits)
    common = [f"c{i}" for i in range(20)]  # a passage that texts share which are not alike
    texts += [" ".join([*common, *(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(3, 60)))]) for _ in range(60)]
    texts += [t for t in texts[:5]] + ["w1 w2 w3", "w1 w2 w3 w4 w5", "", None]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("list_size", [4096, 16])
def test_heavy(spark, rows, monkeypatch, list_size):
    monkeypatch.setattr(jaccard_join, "LIST", list_size)
    df = jaccard_join.near_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    got = {r.doc_id: r.component_id for r in df.collect()}
    assert got == brute_components([(i, t or "") for i, t in rows], 85, 100, 4) | {i: i for i, t in rows if not t}


def test_stars_join_large_groups(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("doc_id", "id")
    prof = jaccard_join.profiles(docs, 4).where("kind = 0 AND n > 0")
    classes = prof.groupBy("c").agg({"id": "min", "n": "min", "bands": "max"}).toDF("c", *[x for x in prof.groupBy("c").agg({"id": "min", "n": "min", "bands": "max"}).columns if x != "c"])
    classes = classes.withColumnsRenamed({"min(id)": "first", "min(n)": "n", "max(bands)": "bands"})
    links = jaccard_join._stars(docs, classes, 4, 85, 100)
    assert links.select("x").distinct().count() > 10


def test_long_near_copies(spark):
    """Two near copies of 300,000 words, and one that is not near enough: bytes follow the words, not their square."""
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**6)}" for _ in range(300_000)]
    near, far = list(words), list(words)
    for text, edits in ((near, 3000), (far, 20_000)):
        for _ in range(edits):
            text[rng.randrange(len(text))] = f"x{rng.randrange(10**6)}"
    rows = [(3, " ".join(words)), (5, " ".join(near)), (4, " ".join(far)), (6, "a b c d e")]
    got = jaccard_join.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {3: 3, 5: 3, 4: 4, 6: 6}


def test_buckets_follow_the_bytes(spark):
    lists = spark.createDataFrame([(k, c, 10) for k in range(200) for c in range(3)], "key long, c long, n int")
    state = spark.createDataFrame([(c, bytes(1 << 20)) for c in range(3)], "c long, sketch binary")
    assert jaccard_join._buckets(lists, state, 4) == 600 * (1 << 20) // jaccard_join.BUCKET_BYTES + 1
    assert jaccard_join._buckets(lists.limit(0), state, 4) == 4
