"""Boxes on pages: scaling, neighbours, joint regions, and what stands inside them.

Boxes are rows (page, id, x0, y0, x1, y1); joins of boxes are by the cells of a
grid (:mod:`colophon.operators.spatial`).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from colophon.operators.folds import sorted_fold
from colophon.operators.graph import components, with_checkpoints
from colophon.operators.pages import joined, whole_pages
from colophon.operators.spatial import CORNERS, touching

#: Points: the largest gaps between neighbours beside and below one another, and what they share at least on the other axis.
ACROSS, DOWN, COMMON = 8.0, 40.0, 5.0
#: The grid looks a point further, since its sums are rounded otherwise than the gaps.
SLACK = 1.0
#: Boxes of a page up to which all its pairs are looked at; fuller pages go through the grid.
FULL = 256


def scaled(boxes: DataFrame, width: float, height: float, least: float = 0.001, area: float = 0.002) -> DataFrame:
    """Thousandths of a page as points; thin and tiny boxes go."""
    w, h = (F.col("x1") - F.col("x0")) / 1000, (F.col("y1") - F.col("y0")) / 1000
    big = boxes.where((w >= least) & (h >= least) & (w * h >= area))
    return big.select("page", "id", *[(F.col(c) / 1000 * s).alias(c) for c, s in (("x0", width), ("y0", height), ("x1", width), ("y1", height))])


def adjacent(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Below one another at 40 points at most with 5 in common across, or beside at 8 at most with 5 in common down."""
    gap = lambda lo, hi: F.greatest(F.lit(0.0), a[lo] - b[hi], b[lo] - a[hi])
    common = lambda lo, hi: F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo])
    return ((gap("y0", "y1") <= DOWN) & (common("x0", "x1") > COMMON)) | ((gap("x0", "x1") <= ACROSS) & (common("y0", "y1") > COMMON))


def neighbours(boxes: DataFrame, *carry: str) -> DataFrame:
    """(page, a, b, a_..., b_...): adjacent boxes, each pair once, found through the grid."""
    pairs = touching(boxes, boxes, ACROSS + SLACK, DOWN + SLACK, (*CORNERS, *carry)).where("a < b")
    return pairs.where(adjacent(*({c: F.col(f"{side}_{c}") for c in CORNERS} for side in "ab")))


def numbered(boxes: DataFrame) -> DataFrame:
    """(page, id, number): boxes without a number take one from their neighbours.

    Neighbours without a number form groups first; a group takes the number of the
    first numbered box beside it, by (y0, x0, id), and stays without one where there is none.
    So no region ever holds two numbers.
    """
    pairs = neighbours(boxes.where("number IS NULL")).select(F.struct("page", F.col("a").alias("id")).alias("a"), F.struct("page", F.col("b").alias("id")).alias("b"))
    groups = components(pairs).select("node.page", "node.id", F.col("component.id").alias("grp"))
    loose = boxes.where("number IS NULL").select("page", "id").distinct().join(groups, ["page", "id"], "left").withColumn("grp", F.coalesce("grp", "id"))
    beside = touching(boxes.where("number IS NULL"), boxes.where("number IS NOT NULL"), ACROSS + SLACK, DOWN + SLACK, (*CORNERS, "number"))
    beside = beside.where(adjacent(*({c: F.col(f"{side}_{c}") for c in CORNERS} for side in "ab")))
    first = beside.join(loose.select("page", F.col("id").alias("a"), "grp"), ["page", "a"]).groupBy("page", "grp").agg(F.min_by("b_number", F.struct("b_y0", "b_x0", "b")).alias("number"))
    given = loose.join(first, ["page", "grp"], "left").select("page", "id", "number")
    return boxes.where("number IS NOT NULL").select("page", "id", "number").unionByName(given)


def _full_page_regions(boxes: DataFrame) -> DataFrame:
    """Adds ``region`` and completes ``number`` for pages of any size: pairs by the grid, components by stars."""
    known = numbered(boxes).distinct().checkpoint()
    all_ = boxes.drop("number").join(known, ["page", "id"])
    same = neighbours(all_, "number").where(F.col("a_number").eqNullSafe(F.col("b_number")))
    groups = components(same.select(F.struct("page", F.col("a").alias("id")).alias("a"), F.struct("page", F.col("b").alias("id")).alias("b")))
    groups = groups.select("node.page", "node.id", F.col("component.id").alias("region"))
    return all_.join(groups, ["page", "id"], "left").withColumn("region", F.coalesce("region", "id"))


def _page_regions(boxes: DataFrame) -> DataFrame:
    """Adds ``region`` and completes ``number`` where no page has more than FULL boxes: a page's boxes pass through one task together."""
    schema = StructType([*boxes.schema.fields, StructField("region", boxes.schema["id"].dataType)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_pages(batches, "page"):
            region, given = joined(rows, ACROSS, DOWN, COMMON)
            out = {c: rows.column(c) for c in rows.column_names}
            out |= {"number": out["number"].take(given), "region": out["id"].take(region)}
            yield from pa.table(out).combine_chunks().to_batches()

    return boxes.repartition("page").sortWithinPartitions("page", "id").mapInArrow(work, schema)


def joint_regions(boxes: DataFrame) -> DataFrame:
    """(page, region, number, n, x0, y0, x1, y1): connected neighbours of one number become one region, named by the least id.

    boxes: (page, id, number, x0, y0, x1, y1), ids distinct on a page (equal rows count each).  Boxes without a
    number join as :func:`numbered` says.  Pages of up to FULL boxes are settled in one pass over sorted pages;
    on fuller ones pairs come from a grid join and components from stars, so neither a long chain nor a full page is one task's work.
    """
    with_checkpoints(boxes.sparkSession)
    boxes = boxes.where("page IS NOT NULL AND id IS NOT NULL")
    full = boxes.groupBy("page").agg(F.count("*").alias("_n")).where(F.col("_n") > FULL).select("page").checkpoint()  # one row for FULL boxes at most
    if full.isEmpty():
        out = _page_regions(boxes)
    else:
        out = _page_regions(boxes.join(full, "page", "left_anti")).unionByName(_full_page_regions(boxes.join(full, "page", "left_semi").checkpoint()))
    ends = [f(c).alias(c) for c, f in (("x0", F.min), ("y0", F.min), ("x1", F.max), ("y1", F.max))]
    captions = []
    if "caption" in boxes.columns:  # one with spaces first, then the longest; topmost where they are alike
        rank = F.struct((~F.contains("caption", F.lit(" "))).alias("plain"), (-F.length("caption")).alias("short"), "y0", "x0", "id")
        captions = [F.coalesce(F.min_by("caption", F.when(F.trim("caption") != "", rank)), F.lit("")).alias("caption")]
    return out.groupBy("page", "region").agg(F.first("number").alias("number"), F.count("*").alias("n"), *ends, *captions)


def inside(words: DataFrame, boxes: DataFrame, slack: float = 0.5) -> DataFrame:
    """(page, box, n_words): words whose centre lies in a box."""
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    points = words.select("page", F.lit(0).alias("id"), x.alias("x0"), y.alias("y0"), x.alias("x1"), y.alias("y1"))
    return touching(points, boxes, slack, slack).groupBy("page", F.col("b").alias("box")).agg(F.count("*").alias("n_words"))


def word_rows(words: DataFrame, slack: float = 2.5) -> DataFrame:
    """Adds ``row``: words from top to bottom share a row while their tops are within ``slack`` of its first word's.

    words: (page, id, x0, y0).
    """

    def step(state, word):
        row, top = state or (-1, None)
        if top is not None and abs(word.y0 - top) <= slack:
            return (row, top), row
        return (row + 1, word.y0), row + 1

    return sorted_fold(words.select("page", "id", "x0", "y0"), "page", ["y0", "x0", "id"], step, "row", "int")


def reading_order(words: DataFrame, width: float) -> DataFrame:
    """Adds ``place``: the left column's rows before the right one's, each from top to bottom, left to right (after :func:`word_rows`)."""
    right = F.col("x0") >= width / 2
    return words.withColumn("place", F.row_number().over(W.partitionBy("page").orderBy(right, "row", "x0", "id")))


def rule_groups(rules: DataFrame, separators: DataFrame) -> DataFrame:
    """(page, grp, n, top, bottom): rule lines (page, y) cut into groups at the separators (page, y) above them."""
    both = rules.select("page", "y", F.lit(1).alias("is_rule")).unionByName(separators.select("page", "y", F.lit(0).alias("is_rule")))
    above = F.sum(1 - F.col("is_rule")).over(W.partitionBy("page").orderBy("y", F.col("is_rule").desc()).rowsBetween(W.unboundedPreceding, W.currentRow))
    cut = both.withColumn("above", above).where("is_rule = 1").groupBy("page", "above").agg(F.count("*").alias("n"), F.min("y").alias("top"), F.max("y").alias("bottom"))
    return cut.select("page", (F.row_number().over(W.partitionBy("page").orderBy("above")) - 1).alias("grp"), "n", "top", "bottom")
