"""Audits of sections and figures: rules first, then a model's reply where the rules find a reason, and the rules' result where it fails."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colophon.functions import papers as P
from colophon.functions import payloads
from colophon.operators import outline

#: Captions that one reply is asked about.
BATCH = 40


def audit_sections(sections: DataFrame, replies: DataFrame) -> DataFrame:
    """(doc, ordinal, title, level, page_start, page_end, by_reply) of the audited outlines.

    sections: (doc, ordinal, title, level, page_start, page_end), replies: (doc, reply).  Sentences that pose as
    headings go.  Where one went, a title is split over two lines or numbers jump, the reply's outline
    is taken, if it has any; without reasons, or without a readable reply, the rules' outline stays.  An
    outline of which nothing would stay is kept as it is.
    """
    rows = outline.heading_issues(sections.withColumn("page", F.col("page_start")), "doc").withColumn("drop", P.body_sentence(F.col("title")) & (F.trim(F.coalesce("title", F.lit(""))) != ""))
    per = W.partitionBy("doc")
    rows = rows.withColumn("kept", F.sum((~F.col("drop")).cast("int")).over(per)).withColumn("asked", F.max(F.col("drop") | F.col("split_title") | F.col("number_jump")).over(per))
    items = replies.groupBy("doc").agg(F.max("reply").alias("reply")).select("doc", payloads.outline_items(F.col("reply")).alias("items")).where("items IS NOT NULL")
    asked = rows.where("asked AND kept > 0").select("doc").distinct()
    told = items.join(asked, "doc", "left_semi")
    new = told.select("doc", F.posexplode("items").alias("ordinal", "i")).select("doc", F.col("ordinal").cast("long").alias("ordinal"), "i.title", "i.level", "i.page_start", "i.page_end", F.lit(True).alias("by_reply"))
    old = rows.join(told.select("doc"), "doc", "left_anti").where("kept = 0 OR NOT drop")
    number = lambda c: F.col(c).cast("long").alias(c)
    return old.select("doc", number("ordinal"), "title", number("level"), number("page_start"), number("page_end"), F.lit(False).alias("by_reply")).unionByName(new)


def audit_figures(items: DataFrame, replies: DataFrame) -> DataFrame:
    """(doc, index, dropped, caption): what becomes of each figure (doc, index, page, kind, caption).

    Of the figures of one number and kind on a page the one whose caption has most spaces stays, then the longest, then the first.
    Letters run together are asked about, BATCH captions a reply (doc, batch, reply); a reply's caption replaces that
    of any figure that stays, and a reply that cannot be read changes nothing.
    """
    text = F.coalesce("caption", F.lit(""))
    number = F.lower(F.regexp_extract(text, r"(?i)^(?:fig(?:ure)?\.?|table)\s*([0-9]+[a-z]?|[IVXLCDM]+)", 1))
    order = W.partitionBy("doc", "page", "kind", "number").orderBy(F.regexp_count(text, F.lit(" ")).desc(), F.length(text).desc(), "index")
    rows = items.withColumn("number", number).withColumn("dropped", (F.col("number") != "") & (F.row_number().over(order) > 1)).withColumn("glued", F.regexp_like(text, F.lit(payloads.GLUED)))
    asked = rows.where("glued").withColumn("batch", F.floor((F.row_number().over(W.partitionBy("doc").orderBy("index")) - 1) / BATCH).cast("int")).select("doc", "batch").distinct()
    fixed = replies.join(asked, ["doc", "batch"], "left_semi").select("doc", "batch", F.posexplode(payloads.captions(F.col("reply"))).alias("at", "c"))
    fixed = fixed.groupBy("doc", F.col("c.index").alias("index")).agg(F.max_by("c.caption", F.struct("batch", "at")).alias("fixed"))  # the last reply counts
    out = rows.join(fixed, ["doc", "index"], "left")
    return out.select("doc", "index", "dropped", F.when(F.col("dropped"), F.col("caption")).otherwise(F.coalesce("fixed", "caption")).alias("caption"))
