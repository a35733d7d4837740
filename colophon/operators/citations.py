"""Citations checked against the chunks that they name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colophon.functions import papers as P


def validate(citations: DataFrame, chunks: DataFrame) -> DataFrame:
    """``citations`` with valid, reason and the page that is shown.

    citations: (asked_paper, paper_id, chunk_id, page, quote); chunks: (chunk_id,
    paper_id, page_start, page_end, text), one row a chunk.  The first reason
    that applies counts: foreign_paper, missing_chunk, foreign_chunk,
    quote_not_found.  Quotes are compared without case, blanks and punctuation;
    an empty one is not found.  A valid citation outside its chunk's pages gets
    the first of them: page_corrected, or page_inferred where it had none.
    """
    c = chunks.select("chunk_id", F.col("paper_id").alias("_owner"), F.col("page_start").alias("_lo"), F.col("page_end").alias("_hi"), P.match_key(F.col("text")).alias("_body"))
    rows = citations.join(c, "chunk_id", "left").withColumn("_quote", P.match_key(F.col("quote")))
    found = (F.coalesce(F.col("_quote"), F.lit("")) != "") & F.contains("_body", F.col("_quote"))
    reason = (
        F.when(~F.col("paper_id").eqNullSafe(F.col("asked_paper")), "foreign_paper")
        .when(F.col("_lo").isNull(), "missing_chunk")
        .when(~F.col("_owner").eqNullSafe(F.col("asked_paper")), "foreign_chunk")
        .when(~F.coalesce(found, F.lit(False)), "quote_not_found")
    )
    rows = rows.withColumn("_bad", reason)
    within = F.coalesce(F.col("page").between(F.col("_lo"), F.col("_hi")), F.lit(False))
    page = F.when(F.col("_bad").isNull(), F.when(within, F.col("page")).otherwise(F.col("_lo")))
    note = F.when(within, "").when(F.col("page").isNull(), "page_inferred").otherwise("page_corrected")
    valid = F.col("_bad").isNull()
    return rows.withColumns({"page": page, "valid": valid, "reason": F.coalesce("_bad", note)}).drop("_owner", "_lo", "_hi", "_body", "_quote", "_bad")


def verdicts(checked: DataFrame, key: str, retries: int) -> DataFrame:
    """(key, n, n_valid, verdict): verified if all are valid; else retry while ``retries`` are left, then downgraded."""
    out = checked.groupBy(key).agg(F.count("*").alias("n"), F.count_if("valid").alias("n_valid"))
    bad = F.lit("retry" if retries > 0 else "downgraded")
    return out.withColumn("verdict", F.when(F.col("n") == F.col("n_valid"), "verified").otherwise(bad))
