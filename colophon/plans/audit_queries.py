"""Queries on audited outlines and figures: lines of documents are titles and captions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colophon.functions import papers as P
from colophon.operators import audits
from colophon.plans.base import query, read

LINES = r"""li AS (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
se AS (SELECT doc, i AS ordinal, regexp_replace(CASE i % 5 WHEN 0 THEN (i // 2 + 1) || '. ' || regexp_extract(line, '^\S*(?:\s+\S+){0,2}') WHEN 1 THEN regexp_extract(line, '^\S*') WHEN 2 THEN i || '. We ' || regexp_extract(line, '^\S*(?:\s+\S+){0,8}') WHEN 3 THEN regexp_extract(line, '^\S*(?:\s+\S+){0,11}') || '.' ELSE 'Part ' || left(line, 9) END, '^\s+|\s+$', '', 'g') AS title, (i + doc) % 3 // 2 + 1 AS level, i // 3 + 1 AS page FROM li)"""


def outlines(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("i", "line"))
    i, some = F.col("i"), lambda n: F.regexp_extract("line", rf"^\S*(?:\s+\S+){{0,{n}}}", 0)
    title = F.when(i % 5 == 0, F.concat(F.floor(i / 2 + 1).cast("string"), F.lit(". "), some(2))).when(i % 5 == 1, F.regexp_extract("line", r"^\S*", 0)).when(i % 5 == 2, F.concat(i.cast("string"), F.lit(". We "), some(8)))
    title = title.when(i % 5 == 3, F.concat(some(11), F.lit("."))).otherwise(F.concat(F.lit("Part "), F.substring("line", 1, 9)))
    page = F.floor(i / 3) + 1
    return rows.select("doc", i.cast("long").alias("ordinal"), P.strip(title).alias("title"), (F.floor((i + F.col("doc")) % 3 / 2) + 1).alias("level"), page.alias("page_start"), page.alias("page_end"))


WORDS = r"len(list_filter(string_split_regex(title, '\s+'), lambda w: w <> ''))"


@query(rf"""WITH {LINES},
f AS (SELECT *, title <> '' AND ((regexp_matches(title, '(?i)^[0-9]+(\.[0-9]+)*[.\s]+({P.OPENERS})\s') AND {WORDS} > 6) OR (NOT regexp_matches(title, '(?i)^([0-9]+|[IVXLC]+|[A-Z])\.?\s') AND title LIKE '%.' AND {WORDS} > 10)) AS gone,
  lag(title) OVER w AS u, lag(page) OVER w AS up, lag(level) OVER w AS ul FROM se WINDOW w AS (PARTITION BY doc ORDER BY ordinal)),
g AS (SELECT *, gone OR coalesce(up = page AND length(u) BETWEEN 1 AND 59 AND length(title) BETWEEN 1 AND 12 AND NOT regexp_matches(u, '[.:;]$') AND regexp_matches(title, '^[A-Za-z]'), false)
  OR coalesce(level = 1 AND ul = 1 AND TRY_CAST(regexp_extract(title, '^([0-9]+)[.\s]', 1) AS INTEGER) - TRY_CAST(regexp_extract(u, '^([0-9]+)[.\s]', 1) AS INTEGER) > 1, false) AS issue FROM f),
h AS (SELECT *, count(*) FILTER (NOT gone) OVER (PARTITION BY doc) AS kept, bool_or(issue) OVER (PARTITION BY doc) AS asked FROM g),
r AS (SELECT doc, ordinal, title, level, page, row_number() OVER (PARTITION BY doc ORDER BY ordinal) - 1 AS n FROM h WHERE asked AND kept > 0 AND doc % 3 = 0)
SELECT doc, ordinal, title, CAST(level AS BIGINT) AS level, CAST(page AS BIGINT) AS page_start, CAST(page AS BIGINT) AS page_end, false AS by_reply FROM h WHERE (kept = 0 OR NOT gone) AND doc NOT IN (SELECT doc FROM r)
UNION ALL SELECT doc, n, '* ' || title, CAST(level AS BIGINT), CAST(page AS BIGINT), 1, true FROM r""")
def section_audit(spark: SparkSession, d: str) -> DataFrame:
    """A third of the documents gets a readable reply (titles with a star, in a fence), a third a broken one, a third none."""
    rows = outlines(spark, d)
    entry = F.struct("ordinal", F.struct(F.concat(F.lit("* "), "title").alias("title"), "level", "page_start").alias("e"))
    whole = rows.groupBy("doc").agg(F.to_json(F.sort_array(F.collect_list(entry))["e"]).alias("json"))
    reply = F.when(F.col("doc") % 3 == 0, F.concat(F.lit("```json\n"), "json", F.lit("\n```"))).otherwise(F.concat(F.lit("[{"), "json"))
    return audits.audit_sections(rows, whole.where("doc % 3 < 2").select("doc", reply.alias("reply")))


@query(rf"""WITH {LINES.split("se AS")[0].rstrip().rstrip(",")},
im AS (SELECT doc, i AS index, i // 6 AS page, CASE WHEN i % 4 = 3 THEN 'table' ELSE 'figure' END AS kind, CASE i % 4 WHEN 3 THEN 'Table ' WHEN 2 THEN '' ELSE 'Fig.' END || (i % 3) || CASE WHEN i % 5 = 4 THEN replace(left(line, 40), ' ', '') ELSE ' ' || left(line, 20) END AS caption FROM li),
n AS (SELECT *, lower(regexp_extract(caption, '(?i)^(?:fig(?:ure)?\.?|table)\s*([0-9]+[a-z]?|[IVXLCDM]+)', 1)) AS number, regexp_matches(caption, '[A-Za-z]{{19,}}') AS glued FROM im),
r AS (SELECT *, number <> '' AND row_number() OVER (PARTITION BY doc, page, kind, number ORDER BY length(caption) - length(replace(caption, ' ', '')) DESC, length(caption) DESC, index) > 1 AS dropped, bool_or(glued) OVER (PARTITION BY doc) AS asked FROM n)
SELECT doc, index, dropped, CASE WHEN NOT dropped AND asked AND doc % 2 = 0 AND index % 2 = 0 THEN 'fixed ' || index ELSE caption END AS caption FROM r""")
def figure_audit(spark: SparkSession, d: str) -> DataFrame:
    """Half of the documents gets a reply that names every second figure; the others' cannot be read."""
    rows = read(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("i", "line"))
    i = F.col("i")
    label = F.when(i % 4 == 3, "Table ").when(i % 4 == 2, "").otherwise("Fig.")
    rest = F.when(i % 5 == 4, F.replace(F.substring("line", 1, 40), F.lit(" "), F.lit(""))).otherwise(F.concat(F.lit(" "), F.substring("line", 1, 20)))
    items = rows.select("doc", i.cast("long").alias("index"), F.floor(i / 6).alias("page"), F.when(i % 4 == 3, "table").otherwise("figure").alias("kind"), F.concat(label, (i % 3).cast("string"), rest).alias("caption"))
    entry = F.when(F.col("index") % 2 == 0, F.struct("index", F.concat(F.lit("fixed "), F.col("index").cast("string")).alias("caption")))
    replies = items.groupBy("doc").agg(F.to_json(F.collect_list(entry)).alias("json"))
    reply = F.when(F.col("doc") % 2 == 0, F.concat(F.lit("Here: "), "json")).otherwise("no [")
    return audits.audit_figures(items, replies.select("doc", F.lit(0).alias("batch"), reply.alias("reply")))
