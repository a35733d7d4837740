"""The title of a first page, by the size of its letters.

A page's pieces are rows (page, size, x0, y0, text).  The title is set in the largest letters
of the page's upper part that are not noise; a lone initial does not count.  Sizes
within ``SAME`` points are one size, so the level of a size is a range window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed values of the rules.
NOISE = r"(?i)arXiv|DOI|ISSN|ISBN|Contents lists|journal homepage|www\.|©|Copyright|Anonymous submission|^\d+$|^[IVXLC]+\s*$"
UPPER, SAME, ROW = 0.45, 0.6, 4.0
EDGES = r"^[ \t.:;,_-]+|[ \t.:;,_-]+$"


def titles(pieces: DataFrame, height: float) -> DataFrame:
    """(page, title): null where a page has no title.

    A page none of whose pieces stands in the upper part is taken whole.  Blank and null pieces are passed over.
    """
    page = W.partitionBy("page")
    text = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    rows = pieces.select("page", F.col("size").cast("double").alias("size"), "x0", "y0", text.alias("text")).where("text <> ''")
    upper = F.col("y0") < UPPER * height
    rows = rows.withColumn("any_upper", F.max(upper).over(page)).where(upper | ~F.col("any_upper"))
    rows = rows.withColumn("good", ~F.regexp_like("text", F.lit(NOISE)))
    # the pieces of a size's level: all sizes down to SAME below it
    level = f"OVER (PARTITION BY page ORDER BY size DESC RANGE BETWEEN UNBOUNDED PRECEDING AND {SAME}D FOLLOWING)"
    rows = rows.withColumn("n", F.expr(f"count_if(good) {level}")).withColumn("longest", F.expr(f"max(CASE WHEN good THEN length(text) END) {level}"))
    chosen = F.max(F.when((F.col("n") > 1) | ((F.col("n") == 1) & (F.col("longest") > 2)), F.col("size"))).over(page)
    held = rows.withColumn("chosen", chosen).where(F.col("good") & (F.col("size") >= F.col("chosen") - SAME))
    lines = held.groupBy("page").agg(F.sort_array(F.collect_list(F.struct(F.bround(F.col("y0") / ROW).alias("row"), "x0", "text")))["text"].alias("parts"))
    title = F.regexp_replace(F.regexp_replace(F.array_join("parts", " "), r"(?U)\s+", " "), EDGES, "")
    every = pieces.select("page").distinct()
    return every.join(lines, "page", "left").select("page", F.nullif(title, F.lit("")).alias("title"))
