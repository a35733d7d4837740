"""Truth tables of the library's operators."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from colophon.functions import text as T
from colophon.operators import chunking, library, retrieval
from colophon.streaming import progress


def test_fusion(spark):
    s = "query_id long, doc_id long, score double, rank int"
    v = spark.createDataFrame([(1, 0, 0.9, 1), (1, 1, 0.5, 2)], s)
    k = spark.createDataFrame([(1, 1, 15.0, 1), (1, 0, 10.0, 2)], s)
    assert [(r.doc_id, r.score) for r in retrieval.fuse(v, k).orderBy("rank").collect()] == [(0, 0.7), (1, 0.3)]
    same = spark.createDataFrame([(1, 0, 0.5, 1), (1, 1, 0.5, 2)], s)
    assert {r.score for r in retrieval.fuse(same, same).collect()} == {1.0}
    assert retrieval.fuse(v.limit(0), k.limit(0)).count() == 0


def test_scores_and_years(spark):
    df = spark.createDataFrame([("4/5", 5), ("two", 3), ("0", 1), (None, 3)], "t string, want int")
    assert all(r.got == r.want for r in df.withColumn("got", T.score_from_reply(F.col("t"))).collect())
    df = spark.createDataFrame([("arXiv:2305.1 in 2019", 2023), ("D:20231215", None), ("2019 and 2021", 2021), ("", None)], "t string, want int")
    got = {r.t: r.got for r in df.withColumn("got", T.publication_year(F.col("t"))).collect()}
    assert got["arXiv:2305.1 in 2019"] == 2023 and got["2019 and 2021"] == 2021 and got[""] is None


def test_chunks_cover_text(spark):
    df = spark.createDataFrame([(1, "x" * 1001), (2, ""), (3, "[Page 7] " + "y" * 600)], "doc_id long, text string")
    c = chunking.chunk_text(df).orderBy("doc_id", "chunk_index").collect()
    assert [(r.start_char, r.end_char) for r in c if r.doc_id == 1] == [(0, 500), (450, 950), (900, 1001)]
    assert [r.page_number for r in c if r.doc_id == 3] == [None, None] or [r.page_number for r in c if r.doc_id == 3][0] is None


def test_keep_all_if_none(spark):
    df = spark.createDataFrame([(1,), (2,)], "x int")
    assert library.keep_all_if_none(df, F.col("x") == 1).count() == 1
    assert library.keep_all_if_none(df, F.col("x") == 9).count() == 2


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, library.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_stream_equals_batch(spark):
    d = "/root/testdata/sf0.001"
    batch = spark.read.parquet(f"{d}/events.parquet")
    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    progress.run_latest(stream, "latest_test").awaitTermination()
    assert sorted(map(tuple, spark.table("latest_test").collect())) == sorted(map(tuple, progress.latest_status(batch).collect()))


def test_quotes_across_word_boundaries(spark):
    import random
    import re

    rng = random.Random(3)
    say = lambda n: "".join(rng.choices(["ab", "é", "b", " ", "-\n", ", "], k=n))
    docs = [(1, "We say that atten-\ntion is all you need, a state-of-the-art idea."), (2, "nothing"), (3, None), (4, "")] + [(i, say(300)) for i in range(5, 25)]
    quotes = [(1, "say that attention is all you need"), (2, "you need a state of the art idea"), (3, "all"), (4, "..."), (5, None), (6, "é")]
    for i in range(7, 60):
        _, text = docs[rng.randrange(4, len(docs))]
        at = rng.randrange(200)
        quotes.append((i, text[at : at + rng.randrange(1, 100)].replace("-\n", rng.choice(["", " "])).upper()))
    strip = lambda t: re.sub(r"[^\w]+", "", (t or "").lower())
    want = sorted((i, d) for i, q in quotes for d, t in docs if strip(q) and strip(q) in strip(t))
    s = "id long, text string"
    q, d = spark.createDataFrame(quotes, s).withColumnRenamed("id", "item_id"), spark.createDataFrame(docs, s).withColumnRenamed("id", "doc_id")
    assert {(1, 1), (2, 1), (3, 1)} <= set(want)
    assert sorted(map(tuple, library.verify_quotes(q, d).collect())) == want


def test_dense_groups_are_small(spark):
    """A full group's scores are held a few at a time and its vectors as arrays; equal scores go by the row's place."""
    rng = np.random.default_rng(1)
    lists = lambda n: pa.chunked_array([pa.FixedSizeListArray.from_arrays(pa.array(rng.integers(-2, 3, n * 8).astype(np.float32)), 8).cast(pa.list_(pa.float32()))])
    asked, rows = lists(retrieval.QUERY_BLOCK), lists(retrieval.ROW_BLOCK)
    tracemalloc.start()
    a, b = retrieval._units(asked), retrieval._units(rows)
    query, at, score = retrieval._best(a, b, 5)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 64e6  # all scores at once would be 134 MB, and their order as much again
    for q in (0, 700, len(a) - 1):
        want = np.round(a[q] @ b.T, 6)
        assert at[query == q].tolist() == np.argsort(-want, kind="stable")[:5].tolist()
    assert len(query) == 5 * len(a) and retrieval._best(a, b[:3], 5)[1].reshape(-1, 3).max() == 2 and not len(retrieval._best(a, b[:0], 5)[0])


def test_keyword_slices_are_small():
    """Rows are scored in slices of bounded words; longer rows, empty ones and nulls come through whole and in order."""
    lists = [["a"] * n if n is not None else None for n in [3, 0, None, retrieval.SLICE + 5, 1, *[1000] * 600, 0]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(lists))), pa.array(lists, pa.list_(pa.string()))], names=["id", "w"])
    parts = list(retrieval._slices([batch, batch.slice(0, 0), batch.slice(1, 3)]))
    assert [i for p in parts for i in p.column(0).to_pylist()] == [*range(len(lists)), 1, 2, 3]
    assert all(p.num_rows == 1 or len(p.column(1).flatten()) <= retrieval.SLICE for p in parts)
    assert [len(x) if x is not None else None for p in parts for x in p.column(1).to_pylist()][: len(lists)] == [len(x) if x is not None else None for x in lists]
