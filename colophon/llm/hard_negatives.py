"""Hard negatives: rows of other labels that score nearly as high as an anchor's positives.

Vectors become integers, and a score is the exact inner product, computed in a
residue number system (:mod:`colophon.llm.residues`).  Two passes are made, each
over cells of at most about ``BLOCK`` rows and ``SLICE`` anchors: the first finds
an anchor's positives among the rows of its label, the second finds, for each
positive, the best rows of other labels whose score lies in the window that the
positive's score opens.  A cell returns its own best few for each anchor; a
window over those makes the result.  Labels with many rows are cut into several
blocks, small ones share a cell, so no label is gathered in one task.

Defined results: rows without id or label, and vectors that are null or empty or
hold a null or non-finite component, take no part.  Vectors meet only others of
their length.  Ties go to the smaller id.  A repeated row is a candidate of its
own, but no row is a candidate for an anchor of its id; of anchors that share an
id, the least (label, vector) is asked.  Vectors of any length and size are
handled; scores beyond long are set to its nearest end before ranking.  A positive of a
negative score opens an empty window.  Extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import join_hot, keep
from .residues import Side, primes_for
from .topk import quantised_column

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: The window in hundredths of the positive's score.
LEAST, MOST = 50, 95
#: Rows and anchors of one cell, about.
BLOCK, SLICE = 4096, 2048
#: Scores that one strip of a cell may hold.
STRIP = 1 << 19
#: Marks a row that is no candidate; below all scores.
_NONE = -(1 << 63)
_INT = pa.int64()


def cells(rows: DataFrame, anchors: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides with (pool, part, slice): each row of a key meets each anchor of the key in one cell.

    Keys of few rows share a pool, one cell; a key of many is dealt by hash over parts and slices.
    """
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n")).join(anchors.groupBy(*keys).agg(F.count("*").alias("n_anchors")), keys)
    counts = keep(counts, "cells")
    total = counts.agg(F.sum("n").alias("n"), F.sum("n_anchors").alias("a")).first()
    light = F.col("n") + F.col("n_anchors") <= BLOCK // 8
    up = lambda n, size: F.when(light, 1).otherwise(F.ceil(F.col(n) / size)).cast("int")
    facts = counts.withColumn("pool", F.when(light, F.pmod(F.xxhash64(*keys), F.lit((total.n or 0) // BLOCK + 1))).otherwise(F.xxhash64(*keys)))
    facts = facts.withColumn("parts", up("n", BLOCK)).withColumn("slices", up("n_anchors", SLICE))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    some = lambda n: F.pmod(F.xxhash64(F.lit(17), "id"), n).cast("int")
    left = join_hot(rows, facts.drop("n_anchors"), keys, "n", total.n or 0).withColumn("part", some("parts")).withColumn("slice", every("slices"))
    right = join_hot(anchors, facts.drop("n"), keys, "n_anchors", total.a or 0).withColumn("slice", some("slices")).withColumn("part", every("parts"))
    left, right = left.drop("n", "parts", "slices"), right.drop("n_anchors", "parts", "slices")
    return left, right.toDF(*right.columns)  # columns of their own: both sides took the cells from one table


def best_columns(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of each row's k highest entries above ``_NONE``, ties to the left; ``score`` is used up."""
    rows = np.arange(len(score))
    found = []
    for _ in range(min(k, score.shape[1])):
        at = score.argmax(1)
        top = score[rows, at]
        ok = top > _NONE
        if not ok.any():
            break
        found.append((rows[ok], at[ok], top[ok]))
        score[rows, at] = _NONE
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


def _matrix(t: pa.Table, column: str = "v") -> np.ndarray:
    return np.asarray(t.column(column).combine_chunks().flatten(), np.int64).reshape(t.num_rows, -1)


def _by_key(left: pa.Table, right: pa.Table, keys: list[str]):
    """The parts of a cell that share a key: a pool holds several."""
    of = lambda t: pd.DataFrame({k: t.column(k).to_numpy() for k in keys}).groupby(keys, sort=True).indices
    rows, anchors = of(left), of(right)
    for key, at in anchors.items():
        if key in rows:
            yield left.take(pa.array(rows[key])), right.take(pa.array(at))


def positives(rows: DataFrame, anchors: DataFrame, primes: list[int], k: int) -> DataFrame:
    """(anchor_id, pos, positive_id, positive_score): each anchor's k best other rows of its label."""
    keys = ["label", "dim"]
    schema = pa.schema([("anchor_id", _INT), ("positive_id", _INT), ("positive_score", _INT)])

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [schema.empty_table()]
        for x, q in _by_key(left, right, keys):
            x = x.sort_by("id")
            ids, asked = x.column("id").to_numpy(), q.column("id").to_numpy()
            a, b = Side(_matrix(q), primes), Side(_matrix(x), primes)
            step = max(1, STRIP // len(ids))
            for lo in range(0, len(asked), step):
                score = a.times(b, lo, lo + step)
                score[asked[lo : lo + step, None] == ids] = _NONE
                row, col, top = best_columns(score, k)
                out.append(pa.table([asked[lo + row], ids[col], top], schema=schema))
        return pa.concat_tables(out)

    left, right = cells(rows, anchors, keys)
    cell = ["pool", "part", "slice"]
    found = left.select(*cell, *keys, "id", "v").groupBy(*cell).cogroup(right.select(*cell, *keys, "id", "v").groupBy(*cell)).applyInArrow(work, "anchor_id long, positive_id long, positive_score long")
    return _ranked(found, W.partitionBy("anchor_id").orderBy(F.col("positive_score").desc(), "positive_id"), "pos", k)


def _ranked(found: DataFrame, order, name: str, k: int) -> DataFrame:
    return found.withColumn(name, F.row_number().over(order)).where(F.col(name) <= k)


def negatives(rows: DataFrame, anchors: DataFrame, primes: list[int], k: int, least: int, most: int) -> DataFrame:
    """(anchor_id, pos, positive_id, positive_score, rank, negative_id, negative_score) for anchors with their ``positives``."""
    names = ("anchor_id", "pos", "positive_id", "positive_score", "negative_id", "negative_score")
    schema = pa.schema([(n, _INT) for n in names])

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [schema.empty_table()]
        for x, q in _by_key(left, right, ["dim"]):
            x = x.sort_by("id")
            ids, labels = x.column("id").to_numpy(), x.column("label").to_numpy()
            asked, own = q.column("id").to_numpy(), q.column("label").to_numpy()
            a, b = Side(_matrix(q), primes), Side(_matrix(x), primes)
            given = q.column("positives").to_pylist()
            step = max(1, STRIP // len(ids) // POSITIVES)
            for lo in range(0, len(asked), step):
                score = a.times(b, lo, lo + step)
                score[(own[lo : lo + step, None] == labels) | (asked[lo : lo + step, None] == ids)] = _NONE
                windows = [(i, p["pos"], p["positive_id"], p["positive_score"]) for i, ps in enumerate(given[lo : lo + step]) for p in ps]
                at, pos, pid, ps = (np.array(c, np.int64) for c in zip(*windows, strict=True))
                # Python integers: a hundredfold score may be beyond long
                low = np.array([-(-least * int(s) // 100) for s in ps], np.int64)
                high = np.array([most * int(s) // 100 for s in ps], np.int64)
                wide = score[at]
                wide[(wide < low[:, None]) | (wide > high[:, None])] = _NONE
                row, col, top = best_columns(wide, k)
                out.append(pa.table([asked[lo + at[row]], pos[row], pid[row], ps[row], ids[col], top], schema=schema))
        return pa.concat_tables(out)

    left, right = cells(rows, anchors, ["dim"])
    cell = ["pool", "part", "slice"]
    right = right.select(*cell, "dim", "id", "label", "v", "positives").groupBy(*cell)
    found = left.select(*cell, "dim", "id", "label", "v").groupBy(*cell).cogroup(right).applyInArrow(work, ", ".join(f"{n} long" for n in names))
    return _ranked(found, W.partitionBy("anchor_id", "pos").orderBy(F.col("negative_score").desc(), "negative_id"), "rank", k)


def mine(
    df: DataFrame, anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding", label: Column | str = "label",
    k_positives: int = POSITIVES, k_negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST, scale: int = SCALE,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows that ``anchor`` marks."""
    label = F.col(label) if isinstance(label, str) else label
    ok, v = quantised_column(F.col(vec_col), scale)
    ok = ok & F.col(id_col).isNotNull() & label.isNotNull()
    rows = df.where(F.coalesce(ok, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), v.alias("v"), F.coalesce(anchor, F.lit(False)).alias("asked"))
    rows = keep(rows.withColumn("dim", F.size("v")), "vectors")
    square = lambda a, x: a + x.cast("double") * x.cast("double")
    reach = rows.agg(F.max(F.aggregate("v", F.lit(0.0), square)).alias("m")).first().m
    primes = primes_for(reach or 0.0)
    asked = rows.where("asked").groupBy("id").agg(F.min(F.struct("label", "v", "dim")).alias("s")).select("id", "s.*")
    asked, rows = keep(asked, "anchors"), rows.drop("asked")
    pos = positives(rows, asked, primes, k_positives)
    pos = keep(pos.groupBy("anchor_id").agg(F.collect_list(F.struct(F.col("pos").cast("long").alias("pos"), "positive_id", "positive_score")).alias("positives")), "positives")
    asked = asked.join(pos, asked.id == pos.anchor_id).drop("anchor_id")
    out = negatives(rows, asked, primes, k_negatives, least, most)
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
