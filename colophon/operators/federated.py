"""Union, enrichment, deduplication and ranking of bibliographic rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def priority_sort(rows: DataFrame, query: str, published: str, level: str, citations: str, position: str) -> DataFrame:
    """Adds ``place`` in each query's result list: published first, then level (null last), citations, the order before."""
    order = [F.col(published).desc(), F.col(level).asc_nulls_last(), F.col(citations).desc(), F.col(position)]
    return rows.withColumn("place", F.row_number().over(W.partitionBy(query).orderBy(*order)))


def richer(a, b):
    """Of two rows the only cited one wins, then one that is an arXiv row, else the later."""
    cited_a, cited_b = a.citations > 0, b.citations > 0
    return F.when(cited_a & ~cited_b, a).when(cited_b & ~cited_a, b).when(a.arxiv & ~b.arxiv, a).when(b.arxiv & ~a.arxiv, b).otherwise(b)


def dedupe(rows: DataFrame, key: str) -> DataFrame:
    """(key, id, citations, n, pos), one row for each key: an ordered fold of :func:`richer`; ``rows`` has (pos, id, citations, arxiv), and the key's first ``pos`` stays.

    The fold is not associative, so a key's rows are folded in order; a key's
    rows are the copies of one title and stay few.
    """
    row = F.struct("pos", "id", "citations", "arxiv")
    folded = rows.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("all"))
    first = F.get("all", F.lit(0))["pos"]
    return folded.select(key, _richest(F.col("all")).alias("best"), F.size("all").alias("n"), first.alias("pos")).select(key, "best.id", "best.citations", "n", "pos")


def _richest(ordered):
    return F.aggregate(F.slice(ordered, F.lit(2), F.greatest(F.size(ordered) - 1, F.lit(0))), F.get(ordered, F.lit(0)), richer)


def dedupe_twice(rows: DataFrame) -> DataFrame:
    """One row for each title, after one for each ``work_id``: (title, id, citations, n, pos).

    rows: (pos, id, work_id, title, citations, arxiv).  Works come first, each at
    its first row's place, then the rows without a work id.
    """
    row = F.struct("pos", "id", "citations", "arxiv", "title")
    works = rows.where("work_id IS NOT NULL").groupBy("work_id").agg(F.array_sort(F.collect_list(row)).alias("all"))
    works = works.select(F.struct(F.lit(0).alias("part"), F.get("all", F.lit(0)).pos.alias("at")).alias("pos"), _richest(F.col("all")).alias("best"))
    rest = rows.where("work_id IS NULL").select(F.struct(F.lit(1).alias("part"), F.col("pos").alias("at")).alias("pos"), "id", "citations", "arxiv", "title")
    return dedupe(works.select("pos", "best.id", "best.citations", "best.arxiv", "best.title").unionByName(rest), "title")


def enrich(rows: DataFrame, extra: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Left join that fills only what is null in ``rows``."""
    side = extra.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    out = rows.join(side, key, "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(c, f"_{c}")).drop(f"_{c}")
    return out


def result_lists(rows: DataFrame, failed: DataFrame) -> DataFrame:
    """(query, window, title, id, citations, place): each window's deduplicated list, best first.

    rows: (query, source_pos, pos, id, work_id, title, citations, arxiv, window), failed: (query, source_pos)
    of the sources that did not answer, whose rows are left out.
    """
    answered = rows.join(failed, ["query", "source_pos"], "left_anti")
    one = F.struct("query", "window")
    keyed = answered.select(
        F.struct("source_pos", "pos").alias("pos"), "id", F.when(F.col("work_id").isNotNull(), F.struct(one.alias("of"), "work_id")).alias("work_id"), F.struct(one.alias("of"), "title").alias("title"), "citations", "arxiv",
    )
    lists = dedupe_twice(keyed).select("title.of.query", "title.of.window", "title.title", "id", "citations", "pos")
    order = W.partitionBy("query", "window").orderBy(F.desc("citations"), "pos")
    return lists.select("query", "window", "title", "id", "citations", F.row_number().over(order).alias("place"))


def read_pages(lists: DataFrame, top_k: int, pages: int) -> DataFrame:
    """(query, page, place, id, citations): pages read one after the other.

    The first window is the list; a page that begins behind its end fetches the window of its
    number, whose new titles are appended, and shows what has come to stand there.
    """
    known = lists.where("window = 1").select("query", "title", "id", "citations", "place", F.lit(1).alias("since"))
    for page in range(2, pages + 1):
        size = known.groupBy("query").agg(F.max("place").alias("size"))
        fresh = lists.where(F.col("window") == page).join(known, ["query", "title"], "left_anti").join(size, "query", "left").withColumn("size", F.coalesce("size", F.lit(0)))
        fresh = fresh.where(F.col("size") <= (page - 1) * top_k)
        place = F.col("size") + F.row_number().over(W.partitionBy("query").orderBy("place"))
        known = known.unionByName(fresh.select("query", "title", "id", "citations", place.alias("place"), F.lit(page).alias("since")))
    page = F.ceil(F.col("place") / top_k).cast("int")
    return known.select("query", page.alias("page"), "place", "id", "citations", "since").where(F.col("page").between(F.col("since"), F.lit(pages))).drop("since")
