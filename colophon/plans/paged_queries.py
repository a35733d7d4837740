"""Queries on a paged search interface, whose answers are recorded from the documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colophon.operators.graph import with_checkpoints
from colophon.plans.base import query, read
from colophon.sources.paged import register

WORKS = """w AS (SELECT doc_id % 20 AS query, doc_id AS rank, 'https://w.org/W' || doc_id AS id, CASE WHEN doc_id % 17 = 0 THEN ' ' ELSE trim(left(text, 40)) END AS title, CASE WHEN doc_id % 13 > 0 THEN CAST(1985 + n_chars % 50 AS INTEGER) END AS year, CAST(n_chars % 97 AS BIGINT) AS cited FROM documents WHERE text IS NOT NULL),
f AS (SELECT *, CAST(count(*) OVER (PARTITION BY query) AS BIGINT) AS total, CAST(row_number() OVER (PARTITION BY query ORDER BY rank) AS INTEGER) AS n FROM w WHERE {years})"""


def recorded(spark: SparkSession, d: str) -> str:
    """A folder with one answer a query, each a list of works in their order; some have no title or no year."""
    with_checkpoints(spark)
    k = F.col("doc_id")
    work = F.struct(
        k.alias("rank"), F.concat(F.lit("https://w.org/W"), k.cast("string")).alias("id"), F.when(k % 17 == 0, " ").otherwise(F.substring("text", 1, 40)).alias("title"),
        F.when(k % 13 > 0, (1985 + F.col("n_chars") % 50).cast("int")).alias("publication_year"), (F.col("n_chars") % 97).alias("cited_by_count"),
    )
    folder = f"{spark.sparkContext.getCheckpointDir()}/answers-{uuid.uuid4().hex}"
    rows = read(spark, d, "documents").where("text IS NOT NULL").select((k % 20).alias("query"), F.to_json(work).alias("value"))
    rows.repartition("query").write.partitionBy("query").text(folder)
    register(spark)
    return folder


@query(f"""WITH {WORKS.format(years="year BETWEEN 2000 AND 2030")}
SELECT query, CAST((n - 1) // 50 + 1 AS INTEGER) AS page, n AS place, id, trim(title, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS title, year, cited, total FROM f WHERE n <= 70 AND trim(title) <> ''""")
def paged_works(spark: SparkSession, d: str) -> DataFrame:
    """The first 70 works of each query from 2000 on: two pages, the second cut."""
    return spark.read.format("paged_works").option("folder", recorded(spark, d)).option("top_k", 70).option("year_min", 2000).load()


@query(f"""WITH {WORKS.format(years="year >= 1999 AND year < 2012")}
SELECT query, CAST((n - 1) // 50 + 1 AS INTEGER) AS page, n AS place, id, trim(title, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS title, year, cited, total FROM f WHERE trim(title) <> ''""")
def filtered_works(spark: SparkSession, d: str) -> DataFrame:
    """All pages of the years 1999 to 2011: the interface answers the filter, so pages and totals are those of its works."""
    return spark.read.format("paged_works").option("folder", recorded(spark, d)).load().where("year >= 1999 AND year < 2012")
