"""Sections found in the lines of texts, and windows that respect them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colophon.functions import headings as H
from colophon.functions import papers as P


def heading_lines(pages: DataFrame) -> DataFrame:
    """(page, pos, offset, title, norm, level, numbered) of the lines of (page, text) that are headings.

    Sentences are no headings; an unnumbered known word above a table's row is
    not one either; and where a page has numbered headings, unnumbered ones stay
    only for the abstract and the references.
    """
    split = pages.select("page", F.split("text", "\n").alias("lines"))
    rows = split.select("page", F.posexplode("lines").alias("pos", "line"))
    w = W.partitionBy("page").orderBy("pos")
    rows = rows.withColumn("next", F.lead("line").over(w))
    start = F.coalesce(F.sum(F.length("line") + 1).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # explode evaluates a line's heading once, whatever reads it afterwards
    heading = F.filter(F.transform(F.array("line"), H.section_heading), lambda h: h.isNotNull())
    rows = rows.withColumn("start", start).select("page", "pos", "line", "next", "start", F.explode(heading).alias("h"))
    label = ~F.col("h.numbered") & F.coalesce(P.table_row(F.col("next")), F.lit(False))
    rows = rows.where(~P.body_sentence(F.col("h.title")) & ~label)
    some = F.max("h.numbered").over(W.partitionBy("page"))
    rows = rows.withColumn("some", some).where(~F.col("some") | F.col("h.numbered") | F.col("h.norm").isin("abstract", "references"))
    at = F.greatest(F.position(F.substring("h.title", 1, 1), F.col("line")) - 1, F.lit(0))
    return rows.select("page", "pos", (F.col("start") + at).alias("offset"), "h.*")


def with_abstract(sections: DataFrame, abstracts: DataFrame) -> DataFrame:
    """(page, ordinal, title, norm): an abstract's section comes first where there is a text for it but no heading; ordinals start at 0."""
    has = sections.where("norm = 'abstract'").select("page").distinct()
    extra = abstracts.where("abstract <> ''").select("page").distinct().join(has, "page", "left_anti")
    extra = extra.select("page", F.lit(-1).alias("pos"), F.lit("Abstract").alias("title"), F.lit("abstract").alias("norm"))
    both = sections.select("page", "pos", "title", "norm").unionByName(extra)
    return both.select("page", (F.row_number().over(W.partitionBy("page").orderBy("pos")) - 1).alias("ordinal"), "title", "norm")


def segments(pages: DataFrame, sections: DataFrame, default: str = "whole text") -> DataFrame:
    """(page, section, begin, end): a page cut at its headings; a page without one is a segment of its own.

    sections: (page, offset, title).  What stands before the first heading belongs to no segment.
    """
    n = pages.select("page", F.length("text").alias("n"))
    end = F.lead("offset").over(W.partitionBy("page").orderBy("offset"))
    cut = sections.select("page", "title", F.col("offset").alias("begin"), end.alias("next"))
    return n.join(cut, "page", "left").select("page", F.coalesce("title", F.lit(default)).alias("section"), F.coalesce("begin", F.lit(0)).alias("begin"), F.coalesce("next", "n").alias("end"))


def segment_windows(pages: DataFrame, parts: DataFrame, size: int = 1000, overlap: int = 120) -> DataFrame:
    """(page, section, ordinal, begin, end, content): windows slide within a segment, never over its end."""
    raw = F.substring(F.col("text"), F.col("begin") + 1, F.col("end") - F.col("begin"))
    rows = parts.join(pages, "page").withColumn("raw", raw).withColumn("body", P.strip(F.col("raw"))).where("body <> ''")
    rows = rows.withColumn("base", F.col("begin") + F.length("raw") - F.length(F.regexp_replace("raw", r"^\s+", "")))
    stride = size - overlap
    steps = F.ceil(F.greatest(F.length("body") - size, F.lit(0)) / stride).cast("int")
    rows = rows.select("page", "section", "base", "body", F.explode(F.sequence(F.lit(0), steps)).alias("k"))
    begin, stop = F.col("k") * stride, F.least(F.col("k") * stride + size, F.length("body"))
    rows = rows.select("page", "section", (F.col("base") + begin).alias("begin"), (F.col("base") + stop).alias("end"), P.strip(F.substring(F.col("body"), begin + 1, stop - begin)).alias("content")).where("content <> ''")
    return rows.withColumn("ordinal", F.row_number().over(W.partitionBy("page").orderBy("begin", "end")) - 1)


def wrong_sections(chunks: DataFrame, parts: DataFrame) -> DataFrame:
    """(page, begin, end, section, right): chunks that lie within a segment of another section.

    Both sides meet by page; a chunk may reach one character over a segment's ends.
    """
    p = parts.select("page", F.col("section").alias("right"), F.col("begin").alias("lo"), F.col("end").alias("hi"))
    return chunks.join(p, "page").where("begin >= lo - 1 AND end <= hi + 1 AND section <> right").select("page", "begin", "end", "section", "right")
