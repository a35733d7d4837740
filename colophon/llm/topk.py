"""Exact top-k inner products with a pivot-distance index.

Every vector is keyed by its nearest pivot and its distance to it (iDistance,
Jagadish et al., 2005); rows of one pivot at similar distances form an annulus.
Neighbouring annuli of a pivot are taken as one while they have ``BLOCK`` rows at
most together, and a larger one is cut into blocks of about ``BLOCK`` rows.  By the triangle
inequality no vector x of an annulus [lo, hi] around pivot p is nearer to q than
max(d(q,p) - hi, lo - d(q,p), 0), which bounds
q.x = (|q|^2 + |x|^2 - |q-x|^2) / 2 from above.  A query sorts the annuli by that
bound and expands in rounds: first the ``FIRST`` best, then ``GROWTH`` times as
many, and so on; after each round its k-th score is known better, and it stops at
the first annulus whose bound does not reach it.  Only annuli that some query
still wants are read and moved in a round, and a block is copied only as often
as the queries that want it fill slices of ``SLICE``.  Where the bounds say little
(many dimensions without clusters) a query meets every block; each meeting moves
one copy of the query, and no task holds more than a few arrays of ``CELLS``
numbers, one block and one slice, whatever the table's size.

Scores are exact integers: matrix products run in float64 where no partial sum
can reach 2**53, in int64 below 2**62, and in unbounded integers above; a score
beyond the range of long is set to its nearest end before ranking.

Vectors that are null or empty, or hold a null or non-finite component, and rows
without an id take no part.  The inner product is defined between vectors of one
length, so each length is searched for itself; a query has fewer results where
its length is rare.  Ties go to the smaller id; a repeated
row is a candidate of its own; extra columns are ignored; an empty table gives
an empty result.  The pivots come from a seeded sample of ``SAMPLE`` rows at
most; all rows are indexed, and the result does not depend on the sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batch, keep, partitions, runs

SCALE = 1024
K = 10
#: Pivots: about half the root of the rows, between these bounds.
LEAST_PIVOTS, MOST_PIVOTS = 16, 1024
RINGS = 16
#: Rows from which the pivots are drawn, at most.
SAMPLE = 8192
BLOCK = 1024
#: Queries that meet a block in one task, about.
SLICE = 8192
#: Queries that a task routes, about.
DEALT = 256
#: Annuli that a query reads in the first round, and the growth of that number by round.
FIRST, GROWTH = 2, 8
#: Numbers that one array of the indexing, the routing or the scan may hold, about.
CELLS = 1 << 18
_LOW, _HIGH = -(1 << 63) + 1, (1 << 63) - 1
#: Score of a query's own row: below all scores.
_OWN = -(1 << 63)


def quantised_column(v: Column, scale: int) -> tuple[Column, Column]:
    """(takes part, floor(scale * x) of every component)."""
    ok = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return ok, F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def quantised(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, v): floor(scale * x) of the vectors that take part."""
    ok, v = quantised_column(F.col(vec_col), scale)
    return df.where(F.coalesce(ok, F.lit(False)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def _narrow(vectors: DataFrame, most: float) -> DataFrame:
    """``v`` in the narrowest type of whole numbers that holds magnitudes up to ``most``."""
    return vectors.withColumn("v", F.col("v").cast(f"array<{'short' if most < 2.0**15 else 'int' if most < 2.0**31 else 'long'}>"))


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int, kind: type = np.float64) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), kind).reshape(-1, dim)


def choose_pivots(vectors: DataFrame, n: int, sample: int = SAMPLE) -> np.ndarray:
    """Well-separated rows of a bounded sample (farthest-first)."""
    rows = vectors.where(F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(max(1, n // sample))) == 0).orderBy(F.xxhash64("id"), "id").limit(sample)
    pool = np.array([r.v for r in rows.collect()], np.float64)
    if not len(pool):  # the sample may miss a small table
        pool = np.array([r.v for r in vectors.limit(1).collect()], np.float64)
    pool = np.unique(pool, axis=0)
    chosen = [0]
    near = ((pool - pool[0]) ** 2).sum(1)
    while len(chosen) < min(max(LEAST_PIVOTS, min(MOST_PIVOTS, isqrt(n) // 2)), len(pool)):
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((pool - pool[chosen[-1]]) ** 2).sum(1))
    # a few rounds of Lloyd's algorithm on the sample bring the pivots into the clusters
    centre = pool[chosen]
    for _ in range(4):
        own = ((pool**2).sum(1)[:, None] - 2 * pool @ centre.T + (centre**2).sum(1)).argmin(1)
        for k in range(len(centre)):
            if (own == k).any():
                centre[k] = pool[own == k].mean(0)
    return np.rint(centre)  # so that _products are exact


def _products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers that do not depend on how the rows are batched.

    Every round orders the annuli anew, and one rounded otherwise could be left out.
    """
    if not len(q) or max((q**2).sum(1).max(), (p**2).sum(1).max()) < 2.0**51:  # every partial sum is exact
        return q @ p.T
    out = np.zeros((len(q), len(p)))
    for j in range(q.shape[1]):
        out += q[:, j, None] * p[:, j]
    return out


def build_index(vectors: DataFrame, pivots: np.ndarray, width: float) -> DataFrame:
    """(pivot, ring, dist, norm2, place, id, v): nearest pivot, annulus, distance, squared length and the row's number in its task."""
    dim, step = pivots.shape[1], max(1, CELLS // max(pivots.shape))
    kind = vectors.schema["v"].dataType.simpleString()
    schema = pa.schema([("pivot", pa.int32()), ("ring", pa.int32()), ("dist", pa.float64()), ("norm2", pa.float64()), ("place", pa.int64()), ("id", pa.int64()), ("v", pa.list_({"array<smallint>": pa.int16(), "array<int>": pa.int32()}.get(kind, pa.int64())))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                x = _matrix(b.column("v"), dim)
                norm2 = (x**2).sum(1)
                own = (norm2[:, None] - 2 * x @ pivots.T + (pivots**2).sum(1)).argmin(1)
                dist = np.sqrt(((x - pivots[own]) ** 2).sum(1))
                ring = np.minimum(dist / width, RINGS - 1).astype(np.int32)
                yield batch(schema, pivot=pa.array(own.astype(np.int32)), ring=pa.array(ring), dist=pa.array(dist), norm2=pa.array(norm2), place=np.arange(before + at, before + at + b.num_rows), id=b.column("id"), v=b.column("v"))
            before += whole.num_rows

    return vectors.mapInArrow(work, f"pivot int, ring int, dist double, norm2 double, place long, id long, v {kind}")


class _Rings:
    """The annuli (at most MOST_PIVOTS * RINGS), small neighbours taken as one, and the bounds that they give a query."""

    def __init__(self, index: DataFrame, pivots: np.ndarray):
        rows = index.groupBy("pivot", "ring").agg(F.count("*").alias("n"), F.min("dist").alias("lo"), F.max("dist").alias("hi"), F.max("norm2").alias("norm2")).collect()
        wide, self.members = [], []  # members: the rings that an annulus is made of
        for pivot, ring, n, lo, hi, norm2 in sorted(rows):
            if wide and wide[-1][0] == pivot and wide[-1][1] + n <= BLOCK:
                _, m, low, high, most = wide.pop()
                n, lo, hi, norm2 = n + m, min(lo, low), max(hi, high), max(norm2, most)
            else:
                self.members.append([])
            self.members[-1].append(ring)
            wide.append((pivot, n, lo, hi, norm2))
        self.pivot, self.n = (np.array([r[c] for r in wide], np.int64) for c in (0, 1))
        self.lo, self.hi, self.norm2 = (np.array([r[c] for r in wide], np.float64) for c in (2, 3, 4))
        self.parts = -(-self.n // BLOCK)
        self.pivots = pivots

    def caps(self, q: np.ndarray) -> np.ndarray:
        """For each query and annulus a bound on the score; rounding only makes it larger."""
        q2, p2 = (q**2).sum(1), (self.pivots**2).sum(1)
        to = np.sqrt(np.maximum(q2[:, None] - 2 * _products(q, self.pivots) + p2, 0))[:, self.pivot]
        slack = 1e-6 * (1 + np.sqrt(q2)[:, None] + np.sqrt(p2)[None, self.pivot])
        near = np.maximum(np.maximum(to - self.hi, self.lo - to) - slack, 0)
        both = q2[:, None] + self.norm2
        return np.clip((both - near**2) / 2 + 1e-3 + 1e-12 * both, _LOW, _HIGH)

    def wanted(self, queries: pa.RecordBatch, lo: int, hi: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, annulus) pairs, CELLS at most at a time: the places lo to hi of each query's order, as far as its k-th score lets it go."""
        step = max(1, CELLS // max(len(self.n), *self.pivots.shape))
        for at in range(0, queries.num_rows, step):
            part = queries.slice(at, step)
            cap = self.caps(_matrix(part.column("v"), self.pivots.shape[1]))
            order = np.argsort(-cap, axis=1, kind="stable")[:, lo:hi]
            least = part.column("kth").fill_null(_LOW).to_numpy()
            row, col = np.nonzero(np.take_along_axis(cap, order, 1) >= least[:, None].astype(np.float64))
            yield at + row, order[row, col]

    def routed(self, queries: pa.RecordBatch, lo: int, hi: int) -> Iterator[pa.RecordBatch]:
        """(at, id, v, kth): a query for each annulus that it wants, in batches of about CELLS components."""
        step = max(1, CELLS // self.pivots.shape[1])
        for row, to in self.wanted(queries, lo, hi):
            for at in range(0, len(row), step):
                some = queries.take(pa.array(row[at : at + step]))
                yield pa.RecordBatch.from_arrays([pa.array(to[at : at + step].astype(np.int32)), *(some.column(c) for c in ("id", "v", "kth"))], names=["at", "id", "v", "kth"])


def _scores(q: pa.Array | pa.ChunkedArray, x: pa.Array | pa.ChunkedArray, dim: int, reach: float) -> np.ndarray:
    """Exact inner products as long; ``reach`` bounds every sum of products."""
    if reach < 2.0**52:
        return (_matrix(q, dim) @ _matrix(x, dim).T).astype(np.int64)
    if reach < 2.0**62:
        return _matrix(q, dim, np.int64) @ _matrix(x, dim, np.int64).T
    return np.clip(np.array(q.to_pylist(), object) @ np.array(x.to_pylist(), object).T, _LOW, _HIGH).astype(np.int64)


def _k_best(score: np.ndarray, ids: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k best scores that reach its least one; ties to the smaller id."""
    ok = score >= least[:, None]
    many = np.flatnonzero(ok.sum(1) > k)
    if len(many):  # at least k scores reach the k-th, and more only by ties
        ok[many] = score[many] >= np.partition(score[many], -k, axis=1)[:, -k, None]
    row, col = np.nonzero(ok)
    order = np.lexsort((ids[col], ~score[row, col], row))  # ~ turns the order and cannot overflow
    row, col = row[order], col[order]
    start, length = runs(row)
    first = np.arange(len(row)) - np.repeat(start, length) < k
    return row[first], col[first]


def _scan(blocks: DataFrame, queries: DataFrame, k: int, dim: int, reach: float) -> DataFrame:
    """Each block's k best for each query that was sent to it.

    Both sides of a group are bounded: a block has about BLOCK rows and a slice
    about SLICE queries.
    """
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        out, ids = [], np.asarray(left["id"])
        step = max(1, CELLS // max(1, len(ids), dim))
        for lo in range(0, right.num_rows if len(ids) else 0, step):
            part = right.slice(lo, step)
            qid, least = np.asarray(part["id"]), np.asarray(part["kth"].fill_null(_LOW))
            score = _scores(part["v"], left["v"], dim, reach)
            score[qid[:, None] == ids[None, :]] = _OWN
            row, col = _k_best(score, ids, least, k)
            out.append(batch(schema, query_id=qid[row], vec_id=ids[col], score=score[row, col]))
        return pa.Table.from_batches(out, schema)

    keys = ["at", "part", "slice"]
    return blocks.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(work, "query_id long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search(vectors: DataFrame, marked: DataFrame, asked: int, k: int) -> DataFrame:
    """(query_id, vec_id, score, rank) for vectors and ``asked`` queries (id, v) of one length; queries have distinct ids or equal rows."""
    spark = vectors.sparkSession
    n = vectors.count()
    pivots = choose_pivots(vectors, n)
    double = lambda x: x.cast("double") * x.cast("double")
    reach, most = vectors.select(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + double(x))), F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))))).first()
    vectors, marked = _narrow(vectors, most), _narrow(marked, most)
    index = keep(build_index(vectors, pivots, max(1.0, 2.0 * float(np.sqrt(reach)) / RINGS / 1.5)), "pivot-index")
    rings = _Rings(index, pivots)
    sent = spark.sparkContext.broadcast(rings)
    best, lo, hi = None, 0, FIRST
    while lo < len(rings.n):
        kth = None if best is None else best.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
        open_ = marked.withColumn("kth", F.lit(None).cast("long")) if kth is None else marked.join(kth, marked.id == kth.query_id, "left").select("id", "v", "kth")
        open_ = open_.repartition(max(1, min(partitions(spark), asked // DEALT)), "id")

        def count(batches: Iterator[pa.RecordBatch], lo=lo, hi=hi) -> Iterator[pa.RecordBatch]:
            n = np.zeros(len(sent.value.n), np.int64)
            for b in batches:
                for _, to in sent.value.wanted(b, lo, hi):
                    n += np.bincount(to, minlength=len(n))
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"at": at.astype(np.int32), "n": n[at]})

        def route(batches: Iterator[pa.RecordBatch], lo=lo, hi=hi) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield from sent.value.routed(b, lo, hi)

        wanted = open_.mapInArrow(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()  # at most one row an annulus
        if not wanted:
            break
        plan = [(r["at"], int(rings.pivot[r["at"]]), rings.members[r["at"]], int(rings.parts[r["at"]]), -(-r.n // SLICE)) for r in wanted]
        plan = spark.createDataFrame(plan, "at int, pivot int, rings array<int>, parts int, slices int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        blocks = index.join(F.broadcast(plan.withColumn("ring", F.explode("rings"))), ["pivot", "ring"]).withColumn("part", F.pmod(F.xxhash64("id", "place"), "parts").cast("int")).withColumn("slice", every("slices"))
        queries = open_.mapInArrow(route, f"at int, id long, v {marked.schema['v'].dataType.simpleString()}, kth long").join(F.broadcast(plan), "at")
        queries = queries.withColumn("slice", F.pmod(F.xxhash64(F.lit(9), "id"), "slices").cast("int")).withColumn("part", every("parts"))
        keys = ["at", "part", "slice"]
        found = _scan(blocks.select(*keys, "id", "v"), queries.select(*keys, "id", "v", "kth"), k, pivots.shape[1], reach)
        best = keep(_best(found if best is None else best.select("query_id", "vec_id", "score").unionByName(found), k), "top-k")
        lo, hi = hi, hi * GROWTH
    return best


def top_k(df: DataFrame, query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows that ``query`` marks, against all other rows.

    Of query rows that share an id, one is asked for each length (the least vector).
    """
    spark = df.sparkSession
    vectors = keep(quantised(df, id_col, vec_col, scale), "vectors")
    marked = quantised(df.where(F.coalesce(query, F.lit(False))), id_col, vec_col, scale)
    marked = keep(marked.groupBy("id", F.size("v").alias("dim")).agg(F.min("v").alias("v")), "queries")
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    for r in marked.groupBy("dim").agg(F.count("*").alias("n")).orderBy("dim").collect():  # one row for each length that is asked
        found = _search(vectors.where(F.size("v") == r.dim), marked.where(F.col("dim") == r.dim).select("id", "v"), r.n, k)
        out = out.unionByName(found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
    return out
