"""Text files as documents: one row a file, read by extension, cleaned and cut."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colophon.functions import papers as P
from colophon.functions import text as T
from colophon.operators import chunking
from colophon.sources import html

TEXT_KINDS = ("txt", "md")
HTML_KINDS = ("html", "htm")


def load_texts(spark: SparkSession, path: str) -> DataFrame:
    """(source, text) of the files at ``path``, whole, as UTF-8; a missing path is an error."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("text"), F.col("_metadata.file_size").alias("file_size"))


def load_files(spark: SparkSession, path: str) -> DataFrame:
    """(source, file_type, file_size, text): text and Markdown as they are, HTML as Markdown.

    A file of another kind is an error (PDF files need a parser that is not part
    of this library).
    """
    rows = load_texts(spark, path).withColumn("file_type", P.file_kind(F.col("source")))
    good = F.col("file_type").isin(*TEXT_KINDS, *HTML_KINDS)
    bad = F.raise_error(F.concat(F.lit("cannot read "), F.col("source")))
    text = F.when(F.col("file_type").isin(*HTML_KINDS), html.html_to_markdown("text")).otherwise(F.col("text"))
    return rows.withColumn("file_type", F.when(F.coalesce(good, F.lit(False)), F.col("file_type")).otherwise(bad)).select("source", "file_type", "file_size", text.alias("text"))


def parsed(docs: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """Chunks of (doc_id, text): cleaned, then cut."""
    return chunking.chunk_text(docs.select("doc_id", T.clean_text(F.col("text")).alias("text")), size, overlap)
