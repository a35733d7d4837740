"""Outlines: where sections end, which page belongs to which, and signs of wrong headings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def section_ends(headings: DataFrame, key: str) -> DataFrame:
    """Adds ``page_end`` to (key, ordinal, page, offset, last_page).

    A section ends on the next heading's page if that stands below its top, else
    on the page before; the last ends with the document; none before its own page.
    """
    w = W.partitionBy(key).orderBy("ordinal")
    page, offset = F.lead("page").over(w), F.lead("offset").over(w)
    end = F.when(page.isNull(), F.col("last_page")).when((page > F.col("page")) & (offset > 0), page).otherwise(page - 1)
    return headings.withColumn("page_end", F.greatest(F.col("page"), end))


def demote_discussions(headings: DataFrame, key: str) -> DataFrame:
    """Adds ``new_level``: an unnumbered discussion after top-level experiments or results belongs to them."""
    before = W.partitionBy(key).orderBy("ordinal").rowsBetween(W.unboundedPreceding, -1)
    top = F.last(F.when(F.col("level") == 1, F.col("norm")), ignorenulls=True).over(before)
    below = (F.col("norm") == "discussion") & ~F.col("numbered") & top.isin("experiments", "results")
    return headings.withColumn("new_level", F.when(F.coalesce(below, F.lit(False)), 2).otherwise(F.col("level")))


def heading_issues(headings: DataFrame, key: str) -> DataFrame:
    """Adds ``split_title`` and ``number_jump``, judged against the heading before."""
    w = W.partitionBy(key).orderBy("ordinal")
    trim = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")
    t, p = trim(F.col("title")), trim(F.lag("title").over(w))
    same_page = F.lag("page").over(w) == F.col("page")
    split = same_page & F.length(p).between(1, 59) & F.length(t).between(1, 12) & ~p.rlike("[.:;]$") & t.rlike("^[A-Za-z]")
    number = lambda c: F.regexp_extract(c, r"^([0-9]+)[.\s]", 1).try_cast("int")
    jump = (F.col("level") == 1) & (F.lag("level").over(w) == 1) & (number(t) - number(p) > 1)
    return headings.withColumn("split_title", F.coalesce(split, F.lit(False))).withColumn("number_jump", F.coalesce(jump, F.lit(False)))


def section_of_pages(pages: DataFrame, sections: DataFrame, key: str, default: str = "whole text") -> DataFrame:
    """(key, page, title): of the sections that cover a page the last; ``default`` without one."""
    s = sections.select(F.col(key).alias("_k"), "ordinal", "title", "page_start", "page_end")
    on = (F.col(key) == F.col("_k")) & F.col("page").between(F.col("page_start"), F.col("page_end"))
    return pages.join(s, on, "left").groupBy(key, "page").agg(F.coalesce(F.max_by("title", "ordinal"), F.lit(default)).alias("title"))


def owner_of_pages(pages: DataFrame, sections: DataFrame, key: str) -> DataFrame:
    """(key, page, owner): the first section that starts on a page, else the first that covers it, else null."""
    s = sections.select(F.col(key).alias("_k"), "ordinal", "page_start", "page_end")
    on = (F.col(key) == F.col("_k")) & F.col("page").between(F.col("page_start"), F.col("page_end"))
    rank = F.struct((F.col("page_start") != F.col("page")).alias("covers"), "ordinal")
    return pages.join(s, on, "left").groupBy(key, "page").agg(F.min_by("ordinal", F.when(F.col("ordinal").isNotNull(), rank)).alias("owner"))


def compress_window(messages: DataFrame, key: str, order: str) -> DataFrame:
    """(key, n, folded, kept): the older half (two at least, of four and more) goes into one summary row."""
    n = F.col("n")
    half = F.when(n >= 4, F.greatest(F.lit(2), F.floor(n / 2))).otherwise(0)
    return messages.groupBy(key).agg(F.count(order).alias("n")).select(key, "n", half.cast("long").alias("folded"), (n - half).cast("long").alias("kept"))
