"""Exact dense, BM25 and hybrid retrieval; evaluation of ranked lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colophon.functions.text import tokens
from colophon.operators.graph import with_checkpoints

K1, B, EPSILON = 1.5, 0.75, 0.25
VECTOR_WEIGHT, KEYWORD_WEIGHT = 0.7, 0.3
#: Queries and rows that meet in one task of a dense search, about.
QUERY_BLOCK, ROW_BLOCK = 1024, 16384
#: Scores that one array operation of a keyword search and of a dense one holds.
CELLS, DENSE_CELLS = 1 << 22, 1 << 20
#: Words of the documents that a keyword search scores together.
SLICE = 1 << 18
#: Words of one paper that meet a block of queries in one task of a search within papers, about, and what a paper counts besides.
PART_WORDS, PAPER_WORDS = 1 << 19, 1 << 14


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, doc_id, score, rank) by cosine; both sides have (id, v).

    Rows meet query blocks in groups of bounded size; each group keeps its k
    best, so what is shuffled afterwards is k rows for a query and group.
    """
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    parts = max(1, -(-vectors.count() // ROW_BLOCK))
    q = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    x = vectors.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    q = q.select(F.col("block").cast("int").alias("qblock"), F.col("part").cast("int").alias("qpart"), F.col("id").alias("qid"), F.col("v").alias("qv"))
    x = x.select(F.col("block").cast("int"), F.col("part").cast("int"), "id", "v")

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("id")
        row, at, score = _best(_units(left.column("qv")), _units(right.column("v")), k)
        return pa.table({"query_id": left.column("qid").take(row), "doc_id": right.column("id").take(at), "score": score})

    found = q.groupBy("qblock", "qpart").cogroup(x.groupBy("block", "part")).applyInArrow(work, "query_id long, doc_id long, score double")
    return ranked(found, k)


def _units(vectors: pa.ChunkedArray) -> np.ndarray:
    """Unit vectors in double precision; a group's vectors never become Python objects."""
    lists = vectors.combine_chunks()
    if lists.null_count or len(set(pc.min_max(pc.list_value_length(lists)).as_py().values())) > 1:
        raise ValueError("vectors are of one length and not null")
    m = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1) if len(lists) else np.zeros((0, 0))
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def _best(asked: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of each query's k best rows, equal scores by the row's place; DENSE_CELLS scores are held at a time."""
    n, none = len(rows), np.zeros(0, np.int64)
    found = [(none, none, np.zeros(0))]
    step = max(1, DENSE_CELLS // max(1, n))
    for lo in range(0, len(asked) if n else 0, step):
        score = np.round(asked[lo : lo + step] @ rows.T, 6)
        least = np.partition(score, n - k, axis=1)[:, n - k, None] if k < n else -np.inf
        query, row = np.nonzero(~(score < least))
        value = score[query, row]
        order = np.lexsort((row, -value, query))
        query, row, value = query[order], row[order], value[order]
        kept = np.arange(len(query)) - np.searchsorted(query, query) < k
        found.append((query[kept] + lo, row[kept], value[kept]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def per_paper_topk(chunks: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, paper, doc_id, score, rank): each paper's k best chunks; chunks have (id, v, paper), queries (id, v).

    A paper's chunks are spread over groups of bounded size; each group sends k
    rows for a query and paper, so a paper of any length is no hot group.
    """
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    parts = max(1, -(-chunks.count() // ROW_BLOCK))
    q = queries.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    x = chunks.select("id", "v", "paper", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    kind = chunks.schema["paper"].dataType.simpleString()

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.filter(right.column("paper").is_valid()).sort_by([("paper", "ascending"), ("id", "ascending")])
        asked, rows = _units(left.column("v")), _units(right.column("v"))
        paper = right.column("paper").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        ends = np.append(np.flatnonzero(np.diff(paper)) + 1, len(paper))
        found = [(row, at + lo, score) for lo, hi in zip(np.append(0, ends[:-1]), ends, strict=True) for row, at, score in [_best(asked, rows[lo:hi], k)]]
        row, at, score = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table({"query_id": left.column("id").take(row), "paper": right.column("paper").take(at), "doc_id": right.column("id").take(at), "score": score})

    found = q.groupBy("block", "part").cogroup(x.groupBy("block", "part")).applyInArrow(work, f"query_id long, paper {kind}, doc_id long, score double")
    order = W.partitionBy("query_id", "paper").orderBy(F.col("score").desc(), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def bm25_weights(docs: DataFrame, queries: DataFrame) -> tuple[DataFrame, float]:
    """(query_id, term, weight) of the asked terms, and the documents' mean length.

    Terms that most documents hold have a negative idf, replaced by EPSILON times
    the mean idf of all terms; a term counts as often as the query repeats it.
    """
    words = docs.select(tokens(F.col("text")).alias("w"))
    stats = words.agg(F.count("*").alias("n"), F.avg(F.size("w")).alias("avgdl")).first()
    df = words.select(F.explode(F.array_distinct("w")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    raw = df.select("term", (F.log(F.lit(stats.n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    # one pass over the vocabulary gives the asked terms' values and the mean
    asked = queries.select(F.col("id").alias("query_id"), F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    mean = raw.agg(F.avg("raw").alias("mean"))
    both = raw.join(asked, "term").join(F.broadcast(mean))  # one row
    idf = F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw"))
    return both.select("query_id", "term", (F.col("qtf") * idf).alias("weight")), float(stats.avgdl or 1.0)


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, doc_id, score, rank): both sides have (id, text); a document without a shared term scores 0 and may fill up the list.

    Queries are taken QUERY_BLOCK at a time; their weighted terms go to every
    task, which scores its documents as they pass and keeps k of them a query.  So
    a stop word never pairs documents with queries over a shuffle.
    """
    spark = docs.sparkSession
    weights, avgdl = bm25_weights(docs, queries)
    weights = weights.persist()
    ids = queries.select("id").distinct()
    blocks = max(1, -(-ids.count() // QUERY_BLOCK))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    rows = docs.select("id", tokens(F.col("text")).alias("w"))
    found = None
    for at in range(blocks):
        asked = np.array(sorted(r.id for r in ids.where(block("id") == at).collect()), np.int64)  # QUERY_BLOCK, about
        held = weights.where(block("query_id") == at).toArrow()  # the terms of these queries
        terms = held.column("term").combine_chunks().dictionary_encode()
        query = np.searchsorted(asked, held.column("query_id").to_numpy())
        term = terms.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(term, kind="stable")
        sent = spark.sparkContext.broadcast((asked, terms.dictionary, term[order], query[order], held.column("weight").to_numpy()[order], avgdl))
        part = rows.mapInArrow(_scorer(sent, k), "query_id long, doc_id long, score double")
        found = part if found is None else found.unionByName(part)
    weights.unpersist()  # every block's terms have been collected
    return ranked(found, k)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (id, words) in slices of about SLICE words, since a word makes several numbers for each query that asks for it."""
    for b in batches:
        words = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(b.column(1)), 0).to_numpy(zero_copy_only=False))])
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(words, words[lo] + SLICE, "right")) - 1)
            yield b.slice(lo, hi - lo)
            lo = hi


def _scorer(sent, k: int):
    return lambda batches: _scores(batches, *sent.value, k)


def _scores(batches, asked, terms, term, query, weight, avgdl: float, k: int) -> Iterator[pa.RecordBatch]:
    """The k best (query_id, doc_id, score) of each asked query among rows (id, words); ``term``, ``query`` and ``weight`` are sorted by term."""
    n_terms, n_asked = len(terms), len(asked)
    begin = np.searchsorted(term, np.arange(n_terms + 1))
    best: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    for b in _slices(batches):
        ids, lists = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
        size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        known = pc.fill_null(pc.index_in(lists.flatten(), value_set=terms), -1).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(ids)), size)
        pair, tf = np.unique((row * n_terms + known)[known >= 0], return_counts=True)
        row, of = pair // max(n_terms, 1), pair % max(n_terms, 1)
        value = tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[row] / avgdl))
        step = max(1, min(len(ids), CELLS // max(1, n_asked)))
        for lo in range(0, len(ids), step):
            mine = slice(*np.searchsorted(row, [lo, lo + step]))
            fan = begin[of[mine] + 1] - begin[of[mine]]
            post = np.arange(fan.sum()) - np.repeat(np.cumsum(fan) - fan - begin[of[mine]], fan)
            cell = query[post] * step + np.repeat(row[mine] - lo, fan)
            score = np.bincount(cell, np.repeat(value[mine], fan) * weight[post], n_asked * step).reshape(n_asked, step)[:, : len(ids) - lo]
            score = np.round(score, 6)
            rank = np.lexsort((np.broadcast_to(ids[lo : lo + step], score.shape), -score), axis=1)[:, :k]
            new = [np.repeat(asked, rank.shape[1]), ids[lo : lo + step][rank].ravel(), np.take_along_axis(score, rank, 1).ravel()]
            best = [np.concatenate(x) for x in zip(best, new, strict=True)]
            order = np.lexsort((best[1], -best[2], best[0]))
            best = [x[order] for x in best]
            first = np.searchsorted(best[0], best[0])
            best = [x[np.arange(len(first)) - first < k] for x in best]
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in best], names=["query_id", "doc_id", "score"])


def minmax(found: DataFrame) -> DataFrame:
    """Scores of each query spread over 0..1; all equal gives 1."""
    w = W.partitionBy("query_id")
    low, high = F.min("score").over(w), F.max("score").over(w)
    return found.withColumn("norm", F.when(high == low, 1.0).otherwise((F.col("score") - low) / (high - low)))


def fuse(vector: DataFrame, keyword: DataFrame, k: int = 5, wv: float = VECTOR_WEIGHT, wk: float = KEYWORD_WEIGHT) -> DataFrame:
    """Weighted sum of the two normalised lists; a missing side counts 0; vector order breaks ties.

    A query without any vector result is ranked by keywords alone, with weight 1.
    """
    v = minmax(vector).select("query_id", "doc_id", F.col("norm").alias("nv"), F.col("rank").alias("rv"))
    t = minmax(keyword).select("query_id", "doc_id", F.col("norm").alias("nk"), F.col("rank").alias("rk"))
    both = v.join(t, ["query_id", "doc_id"], "full")
    alone = F.max("nv").over(W.partitionBy("query_id")).isNull()
    score = F.when(alone, F.col("nk")).otherwise(wv * F.coalesce("nv", F.lit(0.0)) + wk * F.coalesce("nk", F.lit(0.0)))
    both = both.withColumn("score", F.round(score, 6))
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("rv").asc_nulls_last(), F.col("rk").asc_nulls_last(), "doc_id")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "doc_id", "score", "rank")


def hybrid_topk(docs: DataFrame, vectors: DataFrame, texts: DataFrame, query_vectors: DataFrame, k: int = 5, base: DataFrame | None = None) -> DataFrame:
    """Both searches over-fetch 2k, then fuse; with ``base`` (doc_id) they fetch 4k, and only its documents stay after fusion."""
    if base is None:
        return fuse(dense_topk(vectors, query_vectors, 2 * k), bm25_topk(docs, texts, 2 * k), k)
    both = fuse(dense_topk(vectors, query_vectors, 4 * k), bm25_topk(docs, texts, 4 * k), 8 * k).withColumnRenamed("rank", "order")
    order = W.partitionBy("query_id").orderBy("order")
    return both.join(base.distinct(), "doc_id", "left_semi").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "doc_id", "score", "rank")


def ranking_metrics(found: DataFrame, k: int = 5) -> DataFrame:
    """Hit@k, MRR and NDCG@k over (query_id, rank, relevant)."""
    per = found.where(F.col("rank") <= k).groupBy("query_id").agg(
        F.max("relevant").alias("hit"),
        F.coalesce(F.max(F.when(F.col("relevant") == 1, 1 / F.col("rank"))), F.lit(0.0)).alias("rr"),
        F.sum(F.col("relevant") / F.log2(F.col("rank") + 1)).alias("dcg"),
        F.sum("relevant").alias("good"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("good"), F.lit(1)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    per = per.withColumn("ndcg", F.when(F.col("good") > 0, F.col("dcg") / ideal).otherwise(0.0))
    return per.agg(F.round(F.avg("hit"), 6).alias("hit"), F.round(F.avg("rr"), 6).alias("mrr"), F.round(F.avg("ndcg"), 6).alias("ndcg"), F.count("*").alias("queries"))


# --- within each paper -------------------------------------------------------


def paper_bm25(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, paper, doc_id, score, rank): BM25 with each paper's own statistics; chunks have (id, paper, text), queries (id, text).

    Chunks without a shared term score 0 and fill up the list by id.  Chunks of a
    paper meet the weighted terms of a block of queries in groups of bounded size, and each group
    sends k rows for a query and paper.  So a stop word never pairs chunks with queries over a shuffle.
    A paper's terms are dealt into as many parts as its chunks, so a few long papers are no few hot groups.
    """
    with_checkpoints(chunks.sparkSession)
    words = chunks.where("paper IS NOT NULL").select("paper", F.col("id").alias("doc_id"), tokens(F.col("text")).alias("w")).withColumn("len", F.size("w"))
    stats = words.groupBy("paper").agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"), F.coalesce(F.sum("len"), F.lit(0)).alias("words"))
    stats = stats.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("words") / PART_WORDS)).cast("long")).checkpoint()  # a row a paper
    long = F.broadcast(stats.where("parts > 1").select("paper", "parts"))  # one row for PART_WORDS words at most
    part = lambda c: F.pmod(F.xxhash64(c), F.coalesce("parts", F.lit(1)))
    parts = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    terms = words.select("paper", F.explode(F.array_distinct("w")).alias("term"))
    df = terms.groupBy("paper", "term").agg(F.count("*").alias("df")).join(long, "paper", "left").select("paper", part("term").alias("part"), "term", "df")
    df = df.join(stats.select("paper", F.explode(parts).alias("part"), "parts", "n", "avgdl"), ["paper", "part"])
    raw = df.select("paper", "part", "parts", "term", "avgdl", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.groupBy("paper").agg(F.avg("raw").alias("mean"), F.max("parts").alias("parts")).select("paper", F.explode(parts).alias("part"), "mean")
    asked = queries.select(F.col("id").alias("query_id"), F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    idf = F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw"))
    weights = raw.join(asked, "term").join(mean, ["paper", "part"]).select("query_id", "paper", "parts", "term", "avgdl", (F.col("qtf") * idf).alias("weight"))

    size = stats.agg(F.sum("words").alias("words"), F.count("*").alias("papers")).first()
    buckets = max(1, -(-((size.words or 0) + size.papers * PAPER_WORDS) // PART_WORDS))
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block")
    bucket = lambda part: F.pmod(F.xxhash64("paper", part.cast("long")), F.lit(buckets)).cast("int")
    x = words.join(long, "paper", "left").withColumn("bucket", bucket(part("doc_id")))
    x = x.select("bucket", "paper", "doc_id", "w", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).toDF("bucket", "paper", "doc_id", "w", "block")  # columns of their own
    held = F.array_distinct(F.transform(parts, bucket))
    q = weights.select(block, F.explode(held).alias("bucket"), "query_id", "paper", "term", "avgdl", "weight")
    each = queries.select(F.col("id").alias("query_id"), F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket")).distinct()
    q = q.unionByName(each.select(block, "bucket", "query_id"), allowMissingColumns=True)  # queries that share no term have lists too
    kind = chunks.schema["paper"].dataType.simpleString()
    found = q.groupBy("block", "bucket").cogroup(x.groupBy("block", "bucket")).applyInArrow(lambda left, right: _paper_scores(left, right, k), f"query_id long, paper {kind}, doc_id long, score double")
    order = W.partitionBy("query_id", "paper").orderBy(F.col("score").desc(), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _by_paper(rows: pa.Table) -> Iterator[tuple[object, pa.Table]]:
    """The rows of each paper."""
    rows = rows.sort_by("paper")
    code = rows.column("paper").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    ends = np.append(np.flatnonzero(np.diff(code)) + 1, len(code))
    return ((rows.column("paper")[lo].as_py(), rows.slice(lo, hi - lo)) for lo, hi in zip(np.append(0, ends[:-1]), ends, strict=True) if hi > lo)


def _paper_scores(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """(query_id, paper, doc_id, score): each paper's k best rows of ``right`` for the queries of ``left``."""
    asked = np.unique(left.column("query_id").to_numpy())
    weighted = dict(_by_paper(left.filter(left.column("term").is_valid())))
    kind, found = right.schema.field("paper").type, []
    for paper, rows in _by_paper(right) if len(asked) else ():
        held = weighted.get(paper, left.slice(0, 0))
        terms = held.column("term").combine_chunks().dictionary_encode()
        term = terms.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(term, kind="stable")
        query = np.searchsorted(asked, held.column("query_id").to_numpy())
        avgdl = held.column("avgdl")[0].as_py() if len(held) else 1.0
        best = _scores(rows.select(["doc_id", "w"]).to_batches(), asked, terms.dictionary, term[order], query[order], held.column("weight").to_numpy()[order], avgdl, k)
        found += [pa.table({"query_id": b["query_id"], "paper": pa.array([paper] * len(b), kind), "doc_id": b["doc_id"], "score": b["score"]}) for b in best]
    none = pa.schema([("query_id", pa.int64()), ("paper", kind), ("doc_id", pa.int64()), ("score", pa.float64())]).empty_table()
    return pa.concat_tables([none, *found])


def paper_search(chunks: DataFrame, queries: DataFrame, k: int = 8, section: str | None = None) -> DataFrame:
    """(query_id, paper, doc_id, score, rank): hybrid search within each paper.

    chunks: (id, paper, section, text, v), queries: (id, text, v).  4k candidates (all, in a smaller paper) come out of
    twice as many of each list; then only chunks of ``section`` stay, where it is given, and the k best of them are kept.
    """
    fetch = 4 * k
    queries = queries.toDF(*queries.columns)  # columns of their own, where both sides come from one table
    key = lambda df: df.select(F.struct("query_id", "paper").alias("query_id"), "doc_id", "score", "rank")
    both = fuse(key(per_paper_topk(chunks, queries, 2 * fetch)), key(paper_bm25(chunks, queries, 2 * fetch)), fetch)
    both = both.select("query_id.query_id", "query_id.paper", "doc_id", "score", F.col("rank").alias("order"))
    if section is not None:
        both = both.join(chunks.where(F.col("section") == section).select("paper", F.col("id").alias("doc_id")), ["paper", "doc_id"], "left_semi")
    order = W.partitionBy("query_id", "paper").orderBy("order")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("order")


def sampled_papers(chunks: DataFrame, queries: DataFrame, papers: DataFrame, per_paper: int = 5) -> DataFrame:
    """(query_id, place, paper, doc_id, rank): each listed paper's best chunks in the papers' order; papers (paper, place) without chunks give none."""
    some = chunks.join(papers.select("paper"), "paper", "left_semi")
    return paper_search(some, queries, max(1, per_paper)).join(papers, "paper").select("query_id", "place", "paper", "doc_id", "rank")
