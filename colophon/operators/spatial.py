"""Pairs of boxes that touch, by a hierarchical grid.

A box belongs to the level whose cells are at least as large as the box, so it
covers four cells at most, however large it is.  A box looks for others on its
own level and on every coarser one that the other side uses; levels are powers of two, so there
are few.  The join is an equi-join on (page, level, cell), and a pair is
counted in one cell only, that of its common corner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Side of the finest cells, in points.
FINEST = 32.0
CORNERS = ("x0", "y0", "x1", "y1")


def _level(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    size = F.greatest(x1 - x0, y1 - y0, F.lit(FINEST))
    return F.ceil(F.log2(size / FINEST)).cast("int")


def _cells(df: DataFrame) -> DataFrame:
    """Adds (cx, cy) for every cell that the box covers on ``level``."""
    side = F.pow(F.lit(2.0), F.col("level")) * FINEST
    cell = lambda c: F.floor(F.col(c) / side)
    return df.withColumn("cx", F.explode(F.sequence(cell("x0"), cell("x1")))).withColumn("cy", F.explode(F.sequence(cell("y0"), cell("y1"))))


def touching(left: DataFrame, right: DataFrame, across: float = 0.0, down: float = 0.0, carry: tuple[str, ...] = ()) -> DataFrame:
    """(page, a, b), and a_<name>, b_<name> for the columns in ``carry``: boxes (page, id, x0, y0, x1, y1) of both sides that touch when the right ones are
    widened by ``across`` and ``down`` on each side.  Points are boxes of no size.

    Each pair is returned once.  Boxes with a null or reversed side touch nothing.
    """
    proper = "page IS NOT NULL AND x0 <= x1 AND y0 <= y1"
    wide = [(F.col(c) + s * d).alias(c) for c, s, d in (("x0", -1, across), ("y0", -1, down), ("x1", 1, across), ("y1", 1, down))]
    with_side = lambda side: [F.col(c).alias(f"{side}_{c}") for c in carry]
    a = left.where(proper).select("page", F.col("id").alias("a"), *with_side("a"), *CORNERS).withColumn("own", _level(*map(F.col, CORNERS)))
    b = right.where(proper).select("page", F.col("id").alias("b"), *with_side("b"), *wide).withColumn("own", _level(*map(F.col, CORNERS)))
    levels = lambda df: F.broadcast(df.select("own").distinct().agg(F.collect_list("own").alias("levels")))  # noqa: E731  one row of few powers of two

    def found(index: DataFrame, probe: DataFrame, strictly: bool) -> DataFrame:
        """Pairs of a box of ``index`` on its level and a box of ``probe`` of that level or a finer one."""
        at = probe.crossJoin(levels(index)).withColumn("level", F.explode("levels")).where(F.col("level") > F.col("own") if strictly else F.col("level") >= F.col("own"))
        x, y = _cells(index.withColumn("level", F.col("own"))).alias("i"), _cells(at.drop("levels")).alias("p")
        both = x.join(y, ["page", "level", "cx", "cy"])
        low = lambda c: F.greatest(F.col(f"i.{c}0"), F.col(f"p.{c}0"))
        high = lambda c: F.least(F.col(f"i.{c}1"), F.col(f"p.{c}1"))
        side = F.pow(F.lit(2.0), F.col("level")) * FINEST
        once = (F.floor(low("x") / side) == F.col("cx")) & (F.floor(low("y") / side) == F.col("cy"))
        return both.where((low("x") <= high("x")) & (low("y") <= high("y")) & once).select("page", "a", "b", *[f"{side}_{c}" for side in "ab" for c in carry])

    return found(b, a, False).unionByName(found(a, b, True))
