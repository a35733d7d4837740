"""Fixed and page-marked text windows, overlap removal, numbering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colophon.functions.text import PAGE_MARKER


def chunk_text(docs: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """(doc_id, chunk_index, start_char, end_char, page_number, content).

    Windows advance by size - overlap and stop at the first that reaches the
    end.  The page is the last marker in the 200 characters before the window;
    markers are cut from the content unless nothing else is there.
    """
    stride = size - overlap
    n = F.length("text")
    steps = F.ceil(F.greatest(n - size, F.lit(0)) / stride).cast("int")
    df = docs.where(n > 0).select("doc_id", "text", F.explode(F.sequence(F.lit(0), steps)).alias("chunk_index"))
    df = df.withColumn("start_char", F.col("chunk_index") * stride).withColumn("end_char", F.least(F.col("start_char") + size, n))
    before = F.substring(F.col("text"), F.greatest(F.col("start_char") - 199, F.lit(1)), F.least(F.col("start_char"), F.lit(200)))
    page = F.try_element_at(F.regexp_extract_all(before, F.lit(r"\[Page ([0-9]+)\]"), F.lit(1)), F.lit(-1)).cast("int")
    raw = F.substring(F.col("text"), F.col("start_char") + 1, F.col("end_char") - F.col("start_char"))
    cut = F.regexp_replace(F.regexp_replace(raw, PAGE_MARKER, ""), r"^\s+|\s+$", "")
    return df.select("doc_id", "chunk_index", "start_char", "end_char", page.alias("page_number"), F.when(cut == "", raw).otherwise(cut).alias("content"))


def without_overlap(chunks: DataFrame) -> DataFrame:
    """Adds ``fresh``: the part of each window that the one before it does not hold."""
    before = F.lag("end_char").over(W.partitionBy("doc_id").orderBy("chunk_index"))
    skip = F.greatest(F.coalesce(before - F.col("start_char"), F.lit(0)), F.lit(0))
    return chunks.withColumn("fresh_chars", F.col("end_char") - F.col("start_char") - skip)


def slices(docs: DataFrame, width: int = 80) -> DataFrame:
    """(doc_id, pos, piece): the text in pieces of ``width`` characters, for replay."""
    df = docs.where(F.length("text") > 0)
    df = df.select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(width))).alias("pos"))
    return df.select("doc_id", "pos", F.substring(F.col("text"), F.col("pos") + 1, F.lit(width)).alias("piece"))
