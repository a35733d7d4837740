"""Where tables end: rows of words below a caption, up to running text, a heading or the next caption.

Words are boxes (page, x0, x1, top, bottom, text).  Words whose tops fall into one step of ``STEP``
points are a row; a table in one column of a page looks at that column's words only.  The walk down
from a caption is a window over its band's rows: it stops at the first row that forbids to go on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed values of the rules.
STEP, GAP, PATIENCE = 4.0, 8.0, 20
HEADING = r"^\s*(?:[IVXLC]+|\d+(?:\.\d+)*|[A-Z])[.、]\s+[A-Za-z]"
CAPTION = r"(?i)^\s*(?:(?:fig(?:ure)?\.?|table)\s*(?:\d+[a-z]?|[IVXLCDM]+)\s*[:：.]|(?:图|表)\s*(?:\d+[a-z]?|[IVXLCDM]+)\s*[:：.])"


def column_rows(words: DataFrame, width: float) -> DataFrame:
    """(page, side, row, top, bottom, text, gaps): each row of words, for the whole page and for its left and right column.

    ``text`` has no blanks between words, ``gaps`` counts those wider than GAP.
    """
    rows = words.where("text IS NOT NULL").withColumn("row", F.bround(F.col("top") / STEP).cast("long"))
    held = rows.groupBy("page", "row").agg(F.min("top").alias("top"), F.sort_array(F.collect_list(F.struct("x0", "x1", "text", "bottom"))).alias("w"))
    left = lambda w: F.coalesce(w["x0"] < width / 2, F.lit(False))
    sides = [F.struct(F.lit(s).alias("side"), w.alias("w")) for s, w in (("all", F.col("w")), ("left", F.filter("w", left)), ("right", F.filter("w", lambda w: ~left(w))))]
    held = held.select("page", "row", "top", F.inline(F.array(*sides))).where(F.size("w") > 0)
    wide = F.filter(F.sequence(F.lit(1), F.size("w")), lambda i: (i < F.size("w")) & (F.get("w", i)["x0"] - F.get("w", i - 1)["x1"] > GAP))
    return held.select("page", "side", "row", "top", F.array_max(F.col("w")["bottom"]).alias("bottom"), F.array_join(F.col("w")["text"], "").alias("text"), F.size(wide).alias("gaps"))


def row_kinds(rows: DataFrame) -> DataFrame:
    """Adds ``is_row``, and ``ends`` for rows at which a table is over at once; what is looked at twice is a column, so that it is found once."""
    text, digits, size = F.col("text"), F.col("digits"), F.length("text")
    rows = rows.withColumn("digits", F.regexp_count(text, F.lit(r"\d"))).withColumn("title", F.regexp_like(text, F.lit(HEADING)) | F.regexp_like(text, F.lit(CAPTION)))
    short = (size < 45) & ((digits >= 3) | F.regexp_like(text, F.lit(r"\[\d+\]")))
    rows = rows.withColumn("like_row", (F.col("gaps") >= 2) | (digits > 0.3 * size) | short)
    letters = F.regexp_count(text, F.lit(r"[\p{L}\p{N}]"))
    ends = F.col("title") | (~F.col("like_row") & (size >= 45) & (letters >= 20))
    return rows.withColumn("ends", ends).withColumn("is_row", F.col("like_row") & ~F.col("title")).drop("digits", "title", "like_row")


def table_bodies(bands: DataFrame, words: DataFrame, width: float) -> DataFrame:
    """(page, id, body_bottom, n_rows) for bands (page, id, side, y0, y1): the lower edge of the last table row, null without one.

    More than PATIENCE rows in a run that are neither table rows nor running text end a table too.  Words that come clustered
    by page are not shuffled; what is shuffled afterwards has no text.
    """
    rows = row_kinds(column_rows(words, width)).drop("text", "gaps")
    near = bands.join(rows, ["page", "side"]).where((F.col("top") >= F.col("y0") - 2) & (F.col("top") <= F.col("y1")))
    down = W.partitionBy("page", "id").orderBy("row")
    upto = down.rowsBetween(W.unboundedPreceding, W.currentRow)
    near = near.withColumn("n", F.row_number().over(down))
    since = F.col("n") - F.coalesce(F.max(F.when(F.col("is_row"), F.col("n"))).over(upto), F.lit(0))
    near = near.withColumn("over", F.max(F.col("ends") | (~F.col("is_row") & (since > PATIENCE))).over(upto))
    held = near.where("is_row AND NOT over").groupBy("page", "id").agg(F.max_by("bottom", "n").alias("body_bottom"), F.count("*").alias("n_rows"))
    return bands.select("page", "id").join(held, ["page", "id"], "left").select("page", "id", "body_bottom", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))
