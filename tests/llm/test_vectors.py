"""Vector links and hard negatives against brute force; residue products against unbounded integers."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from colophon.llm import hard_negatives, queries, residues, vector_links

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int, row string, n long, v int"
NAN, INF = float("nan"), float("inf")


def sql_rows(sql):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    rel = con.sql(sql)
    return sorted(rel.columns), sorted(rel.select(*[f'"{c}"' for c in sorted(rel.columns)]).fetchall())


@pytest.mark.parametrize("name", ["op11_vector_links", "op12_hard_negatives"])
def test_against_sql(spark, name):
    got = queries.QUERIES[name](spark, SF)
    columns, want = sql_rows(queries.ORACLE_SQL[name])
    assert sorted(got.columns) == columns and sorted(tuple(r) for r in got.select(columns).collect()) == want


# --- links -------------------------------------------------------------------


def brute_links(rows, threshold=0.93):
    """(vec_id, n_links, component_id) of every row, by all pairs."""

    def takes_part(i, v, label):
        return i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    ok = [k for k, r in enumerate(rows) if takes_part(r[0], r[1], r[2])]
    unit = {}
    for k in ok:
        x = np.array(rows[k][1], float)
        x = x / np.abs(x).max()
        unit[k] = x / np.sqrt(x @ x)
    links = {k: [j for j in ok if j != k and rows[j][2] == rows[k][2] and len(unit[j]) == len(unit[k]) and unit[j] @ unit[k] >= threshold] for k in ok}
    root = {rows[k][0]: rows[k][0] for k in ok}
    changed = True
    while changed:
        changed = False
        for k, js in links.items():
            low = min([root[rows[k][0]], *(root[rows[j][0]] for j in js)])
            changed |= low != root[rows[k][0]]
            root[rows[k][0]] = low
    return [(i, len(links.get(k, ())), root.get(i, i)) for k, (i, *_) in enumerate(rows)]


def check_links(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    got = vector_links.vector_links(df).collect()
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)
    key = lambda t: tuple((x is None, x) for x in t)
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=key) == sorted(brute_links(rows), key=key)


def clusters(seed, n, dim, centres, labels, spread):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dim))
    return [(int(i), [float(x) for x in middle[rng.integers(centres)] + spread * rng.normal(size=dim)], int(rng.integers(labels))) for i in rng.permutation(n)]


def test_links_and_odd_rows(spark):
    odd = [
        (900, None, 1), (901, [], 1), (902, [0.0, 0.0], 1), (903, [NAN, 1.0], 1), (904, [INF, 1.0], 1), (905, [None, 1.0], 1), (906, [1.0, 0.0], None), (None, [1.0, 0.0], 1), (None, None, None),
        (910, [1e300, 1e300], 2), (911, [1e-300, 1e-300], 2), (912, [5e-324, 5e-324], 2), (913, [1.0, -1.0], 2), (914, [1.0, 1.0, 0.0], 2),
        (920, [3.0, 4.0], 3), (920, [3.0, 4.0], 3), (921, [0.0, 1.0], 3), (921, [3.0, 4.1], 3), (922, [1.0, 0.0], 3), (923, [0.93, math.sqrt(1 - 0.93**2)], 3), (924, [1e5], 4), (925, [2.0], 4), (926, [-2.0], 4),
    ]
    check_links(spark, odd + clusters(1, 300, 12, 40, 6, 0.15))
    check_links(spark, [])
    check_links(spark, [(1, None, 1)])


def test_links_over_many_tiles(spark, monkeypatch):
    """Small tiles: deep cells, parts by hash, pools of small labels, and a group of copies in several tiles."""
    monkeypatch.setattr(vector_links, "BLOCK", 64)
    rows = clusters(2, 700, 20, 30, 2, 0.12) + [(1000 + i, v, 7 + i % 40) for i, v, _ in clusters(3, 200, 20, 8, 1, 0.1)]
    rows += [(2000 + i, [1.0 + i * 1e-4, *[0.5] * 19], 1) for i in range(400)]
    check_links(spark, rows)


def test_far_tiles_are_not_compared(spark, monkeypatch):
    monkeypatch.setattr(vector_links, "BLOCK", 64)
    rows = spark.createDataFrame(clusters(4, 2000, 4, 16, 1, 0.02), "id long, v array<double>, label long").withColumn("row", F.col("id"))
    axes = vector_links.Axes(np.array([r.v for r in rows.collect()]), 4)
    tiles = vector_links.tiled(vector_links.placed(rows, axes), 64).persist()
    n = tiles.select("pool", "cell", "part").distinct().count()
    assert tiles.groupBy("pool", "cell", "part").count().agg(F.max("count")).first()[0] < 128
    assert vector_links.tile_pairs(tiles, axes.lead, 0.93).count() < n * (n + 1) // 4
    tiles.unpersist()


def test_forest_connects_what_the_links_connect():
    rng = np.random.default_rng(5)
    for _ in range(30):
        links = rng.random((rng.integers(1, 40), rng.integers(1, 40))) < 0.04
        r, c = vector_links.forest(links)
        assert links[r, c].all() and len(r) < sum(links.shape)

        def parts(i, j, shape=links.shape):
            lab = np.arange(sum(shape))
            for _ in range(len(lab)):
                for x, y in zip(i, j + shape[0], strict=True):
                    lab[x] = lab[y] = min(lab[x], lab[y])
            return lab.tolist()

        assert parts(*np.nonzero(links)) == parts(r, c)


# --- residues and hard negatives --------------------------------------------


@pytest.mark.parametrize(("size", "dim"), [(1, 3), (300, 64), (2**20, 9000), (2**40, 5), (2**62, 7)])
def test_residue_products(size, dim):
    rng = random.Random(size)
    a, b = (np.array([[rng.randint(-size, size) for _ in range(dim)] for _ in range(4)], np.int64) for _ in range(2))
    a[0], b[0] = size, size
    b[1] = -size
    primes = residues.primes_for(float(size) ** 2 * dim)
    got = residues.Side(a, primes).times(residues.Side(b, primes), 0, 4)
    want = a.astype(object) @ b.astype(object).T
    assert got.tolist() == np.clip(want, residues.LOW, residues.HIGH).tolist()
    assert all((p // 2) ** 2 * (residues.EXACT // (p // 2) ** 2) <= residues.EXACT for p in primes)


def brute_negatives(rows, every=50):
    clip = lambda s: max(residues.LOW, min(residues.HIGH, s))
    ok = [(i, [max(-(2**63), min(2**63 - 1, math.floor(256 * x))) for x in v], label) for i, v, label in rows if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    anchors = {}
    for i, v, label in ok:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (label, v)), (label, v))
    out = []
    for a, (own, q) in anchors.items():
        others = sorted((-clip(sum(x * y for x, y in zip(q, v, strict=True))), i, label) for i, v, label in ok if i != a and len(v) == len(q))
        for ps, p, _ in [o for o in others if o[2] == own][:5]:
            fit = [o for o in others if o[2] != own and 50 * -ps <= 100 * -o[0] <= 95 * -ps][:3]
            out += [(a, p, k + 1, n, -ps, -s) for k, (s, n, _) in enumerate(fit)]
    return sorted(out)


def check_negatives(spark, rows):
    got = hard_negatives.mine(spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA), F.col("vec_id") % 50 == 0)
    columns = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    assert sorted(tuple(r) for r in got.select(*columns).collect()) == brute_negatives(rows)


def test_negatives_and_odd_rows(spark):
    odd = [
        (1000, None, 1), (1050, [], 1), (1100, [NAN, 1.0], 1), (1150, [None, 1.0], 1), (1200, [1.0, 0.0], None), (None, [1.0, 0.0], 1), (1250, [INF, 0.0], 0),
        (1300, [1.0, 0.0], 1), (1301, [1.0, 0.0], 1), (1302, [0.9, 0.0], 2), (1302, [0.9, 0.0], 2), (1303, [0.9, 0.1], 3), (1304, [0.0, 1.0], 1), (1300, [1.0, 0.5], 2), (1301, [1.0, 0.0], 1),
        (1350, [1e17, -1e17, 1e16], 1), (1351, [1e17, -1e17, 0.0], 1), (1352, [6e16, -6e16, 0.0], 2), (1353, [-1e17, 1e17, 0.0], 1), (1354, [1e12, 0.0, 0.0], 3), (1400, [3.0], 1), (1401, [-3.0], 1), (1402, [2.0], 2),
    ]
    check_negatives(spark, odd + clusters(6, 400, 8, 25, 6, 0.3))
    check_negatives(spark, [])
    check_negatives(spark, [(50, [1.0], 1)])


def test_negatives_over_many_cells(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 32)
    monkeypatch.setattr(hard_negatives, "SLICE", 4)
    monkeypatch.setattr(hard_negatives, "STRIP", 200)
    rows = clusters(7, 600, 6, 20, 3, 0.4) + [(700 + i, v, 9 + i % 30) for i, v, _ in clusters(8, 150, 6, 10, 1, 0.3)]
    check_negatives(spark, rows + [(5000 + i, [1.0, 2.0, 3.0, 0.0, 0.0, 0.0], 1) for i in range(300)])  # a third is one vector
