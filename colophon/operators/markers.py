"""Page markers: where each page of a document begins in another rendering of its text.

A page is known by its first characters without white space; pages are looked
for one after the other, each behind the one found before, in the text without white
space.  Places are mapped back to the text by running sums over its words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Characters of an anchor, and the fewest that make one.
ANCHOR, LEAST = 80, 10
#: White space, Unicode included.
SPACE = r"[\s\p{Z}\x{85}\x1c-\x1f]"


def found_pages(texts: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, page, place): where the pages (id, page, text) begin in the texts (id, text) without white space; pages not found are left out."""
    squeeze = lambda c: F.regexp_replace(c, rf"{SPACE}+", "")
    anchors = pages.select("id", "page", F.substring(squeeze("text"), 1, ANCHOR).alias("anchor")).where(F.length("anchor") >= LEAST)
    anchors = anchors.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("page", "anchor"))).alias("anchors"))
    both = texts.select("id", squeeze("text").alias("clean")).join(anchors, "id")
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<page:int,place:int>>").alias("found"))

    def step(state, a):
        at = F.position(a["anchor"], F.col("clean"), state["end"] + 1)
        mark = F.struct(a["page"].cast("int").alias("page"), (at - 1).alias("place"))
        return F.when(at > 0, F.struct((at - 1 + F.length(a["anchor"])).alias("end"), F.concat(state["found"], F.array(mark)).alias("found"))).otherwise(state)

    return both.select("id", F.explode(F.aggregate("anchors", start, step)["found"]).alias("m")).select("id", "m.page", "m.place")


def offsets(texts: DataFrame, places: DataFrame) -> DataFrame:
    """places (id, page, place) with ``offset``: the place in the text as it is."""
    words = texts.select("id", F.posexplode(F.regexp_extract_all("text", F.lit(rf"({SPACE}*)([^\s\p{{Z}}\x{{85}}\x1c-\x1f]+)"), F.lit(0))).alias("k", "w"))
    bare = F.length(F.regexp_replace("w", rf"^{SPACE}+", ""))
    upto = W.partitionBy("id").orderBy("k").rowsBetween(W.unboundedPreceding, W.currentRow)
    words = words.select("id", "k", F.length("w").alias("n"), bare.alias("bare"))
    # where the word begins, with and without white space
    words = words.select("id", (F.sum("bare").over(upto) - F.col("bare")).alias("at"), F.struct((F.sum("n").over(upto) - F.col("bare")).alias("whole"), (F.sum("bare").over(upto) - F.col("bare")).alias("clean")).alias("word"), F.lit(None).cast("int").alias("page"))
    rows = words.unionByName(places.select("id", F.col("place").cast("long").alias("at"), F.lit(None).alias("word"), "page"))
    last = F.last("word", ignorenulls=True).over(W.partitionBy("id").orderBy("at", F.asc_nulls_first("page")).rowsBetween(W.unboundedPreceding, W.currentRow))
    rows = rows.withColumn("word", last).where("page IS NOT NULL")
    return rows.select("id", "page", F.col("at").cast("int").alias("place"), (F.col("word.whole") + F.col("at") - F.col("word.clean")).cast("int").alias("offset"))


def with_page_markers(texts: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, text): ``[Page n]`` before the first character of every page that is found.

    Ids of texts are distinct; texts without pages stay as they are, null texts stay null.
    """
    marks = offsets(texts, found_pages(texts, pages)).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("offset", "page"))).alias("m"))
    begin = lambda i: F.when(i == 0, 0).otherwise(F.get("m", i - 1)["offset"])
    end = lambda i: F.when(i == F.size("m"), F.length("text")).otherwise(F.get("m", i)["offset"])
    label = lambda i: F.when(i == 0, "").otherwise(F.concat(F.lit("[Page "), F.get("m", i - 1)["page"].cast("string"), F.lit("] ")))
    cut = F.transform(F.sequence(F.lit(0), F.size("m")), lambda i: F.concat(label(i), F.substring("text", begin(i) + 1, end(i) - begin(i))))
    return texts.select("id", "text").join(marks, "id", "left").select("id", F.when(F.col("m").isNull(), F.col("text")).otherwise(F.array_join(cut, "")).alias("text"))
