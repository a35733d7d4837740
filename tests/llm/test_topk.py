"""Exact search against brute force in unbounded integers."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from colophon.llm import topk

LOW, HIGH = -(2**63) + 1, 2**63 - 1


def brute(rows, k=10, every=100):
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    ok = [(i, [max(-(2**63), min(HIGH, x)) for x in v]) for i, v in ok]
    out = {}
    for q, a in ok:
        if q % every == 0:
            near = sorted((-max(LOW, min(HIGH, sum(x * y for x, y in zip(a, b, strict=True)))), i) for i, b in ok if i != q and len(b) == len(a))[:k]
            out |= {(q, len(a), n + 1): (i, -s) for n, (s, i) in enumerate(near)}
    return out


def found(spark, rows, every=100):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("x")).withColumn("v", F.lit(1))
    dim = {i: len(v) for i, v in rows if v}
    return {(r.query_id, dim[r.query_id], r["rank"]): (r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % every == 0).collect()}


@pytest.mark.parametrize("scale", [1.0, 1e6, 1e12, 1e300])
def test_sizes_of_components(spark, scale):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) * scale for _ in range(5)]) for i in range(401)]
    assert found(spark, rows) == brute(rows)


def test_clusters_ties_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "SLICE", 4)
    rng = random.Random(3)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(8)]
    rows = [(i, [c + rng.gauss(0, 0.05) for c in rng.choice(centres)]) for i in range(1200)]
    rows += [(2000 + i, centres[0]) for i in range(300)] + [(7, rows[7][1]), (7, rows[7][1]), (7, [9.0] * 6)]
    assert found(spark, rows, every=50) == brute(rows, every=50)


def test_lengths_and_rows_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0]), (2, []), (3, None), (100, [2.0]), (200, []), (300, [1.0, 2.0, 3.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [float("inf"), 1.0]), (8, [0.5, 0.5]), (9, [3.0]), (None, [1.0])]
    assert found(spark, rows) == brute(rows)
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.lit(True)).collect() == []


def test_vectors_without_clusters(spark, monkeypatch):
    """No bound helps, and a query meets the annuli of a pivot together, not each for itself."""
    sent, scan = [], topk._scan
    monkeypatch.setattr(topk, "_scan", lambda blocks, queries, *a: sent.append(queries.count()) or scan(blocks, queries, *a))
    x = np.random.default_rng(4).normal(size=(1000, 64))
    rows = [(i, v.tolist()) for i, v in enumerate(x / np.sqrt((x**2).sum(1))[:, None])]
    assert found(spark, rows, every=10) == brute(rows, every=10)
    assert sum(sent) <= 100 * topk.LEAST_PIVOTS


def test_repeats_of_one_row_fill_several_blocks(spark, monkeypatch):
    """An id that many rows share is dealt out like others."""
    monkeypatch.setattr(topk, "BLOCK", 16)
    most, scan = [], topk._scan
    monkeypatch.setattr(topk, "_scan", lambda blocks, *a: most.append(blocks.groupBy(*[c for c in blocks.columns if c not in ("id", "v")]).count().agg(F.max("count")).first()[0]) or scan(blocks, *a))
    rows = [(i, [float(i), 1.0]) for i in range(20)] + [(7, [7.0, 1.0])] * 400
    assert found(spark, rows, every=10) == brute(rows, every=10)
    assert max(most) <= 48


def rings(annuli, dim, scale):
    """Annuli around as many pivots, all of which every query wants."""
    out, rng = object.__new__(topk._Rings), np.random.default_rng(5)
    out.pivots = np.rint(rng.normal(size=(annuli, dim)) * scale)
    out.pivot, out.n, out.parts = np.arange(annuli), np.full(annuli, 10), np.ones(annuli, np.int64)
    out.lo, out.hi, out.norm2 = np.zeros(annuli), np.full(annuli, 100 * scale), np.full(annuli, 100.0 * scale**2)
    return out


def test_routed_batches_are_bounded():
    r, n, dim = rings(200, 64, 300), 2000, 64
    v = pa.ListArray.from_arrays(np.arange(0, n * dim + 1, dim, dtype=np.int32), pa.array(np.arange(n * dim) % 999))
    asked = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), v, pa.nulls(n, pa.int64())], names=["id", "v", "kth"])
    seen = np.zeros((n, 200), np.int64)
    for b in r.routed(asked, 0, 1 << 30):
        assert 0 < b.num_rows * dim <= topk.CELLS
        assert b.column("v").to_pylist()[0] == v[b.column("id")[0].as_py()].as_py()
        np.add.at(seen, (np.asarray(b.column("id")), np.asarray(b.column("at"))), 1)
    assert (seen == 1).all()


@pytest.mark.parametrize("scale", [300, 1e9])
def test_bounds_do_not_depend_on_batches(scale):
    """The rounds order the annuli anew, from batches cut elsewhere."""
    r = rings(40, 64, scale)
    r.hi[:] = 0
    q = np.rint(np.random.default_rng(6).normal(size=(300, 64)) * scale)
    assert all((r.caps(q)[i] == r.caps(q[i : i + 1])[0]).all() for i in range(0, 300, 7))


def test_k_best_of_ties():
    rng = random.Random(8)
    for most in (1, 3, 10**6):
        score = np.array([[rng.randint(-most, most) for _ in range(50)] for _ in range(20)])
        score[:, 7] = -(2**63)
        ids, least = np.array(rng.sample(range(100), 50)), np.array([LOW] * 10 + [0] * 10)
        row, col = topk._k_best(score, ids, least, 10)
        want = [(i, j) for i in range(20) for j in sorted((j for j in range(50) if score[i, j] >= least[i]), key=lambda j: (-score[i, j], ids[j]))[:10]]
        assert list(zip(row, col, strict=True)) == want
