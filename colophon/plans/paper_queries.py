"""Queries on texts, venues, outlines and matches.

Order lines stand for an outline: an order is a paper, its lines are sections.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colophon.functions import papers as P
from colophon.functions import venues as V
from colophon.functions.unicode import match_key, nfkc
from colophon.operators import chunking, folds, matching, outline
from colophon.plans.base import query, read

# --- texts -------------------------------------------------------------------

STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)"


def lines(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


@query(rf"""SELECT doc_id, md5(array_to_string(list_transform(string_split(regexp_replace(text, '\n{{3,}}', chr(10) || chr(10), 'g'), chr(10)), lambda x: {STRIP.format("x")}), chr(10))) AS digest FROM documents""")
def noise_clean(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.md5(P.clean_lines(F.col("text")).cast("binary")).alias("digest"))


@query(rf"""WITH t AS (SELECT doc_id, array_to_string(list_transform(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)), lambda x: {STRIP.format("regexp_replace(x, '[ \t]+', ' ', 'g')")}), chr(10)) AS t FROM documents)
SELECT doc_id, md5({STRIP.format("regexp_replace(t, chr(10) || '{3,}', chr(10) || chr(10), 'g')")}) AS digest FROM t""")
def squeeze_lines(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.md5(P.squeeze_lines(nfkc(F.col("text"))).cast("binary")).alias("digest"))


@query(r"""SELECT item_id, md5(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\p{L}\p{N}_]+', '', 'g')) AS digest, trim(regexp_replace(lower(text), '[^a-z0-9 ]+', ' ', 'g')) AS terms FROM benchmark""")
def match_keys(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    return read(spark, d, "benchmark").select("item_id", F.md5(match_key(text).cast("binary")).alias("digest"), P.search_terms(text).alias("terms"))


@query(r"""WITH n AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE l_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'IV' WHEN 2 THEN 'B' WHEN 3 THEN CAST(l_linenumber AS VARCHAR) || '.' || l_suppkey ELSE '1.2.3.' || l_suppkey END AS number FROM lineitem)
SELECT coalesce(number, '-') AS number, CAST(CASE WHEN number IS NULL OR regexp_full_match(number, '[IVXLC]*') THEN 1 WHEN regexp_full_match(number, '[A-Z]') THEN 2 ELSE least(3, 1 + length(number) - length(replace(number, '.', ''))) END AS INTEGER) AS level, count(*) AS n FROM n GROUP BY ALL""")
def heading_levels(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("l_partkey") % 5
    deep = F.concat_ws(".", F.col("l_linenumber").cast("string"), F.col("l_suppkey").cast("string"))
    number = F.when(m == 1, "IV").when(m == 2, "B").when(m == 3, deep).when(m == 4, F.concat(F.lit("1.2.3."), F.col("l_suppkey").cast("string")))
    rows = read(spark, d, "lineitem").select(number.alias("number"))
    return rows.groupBy(F.coalesce("number", F.lit("-")).alias("number"), P.heading_level(F.col("number")).alias("level")).agg(F.count("*").alias("n"))


@query(rf"""WITH {LINES}
SELECT doc_id, CAST(pos AS INTEGER) AS pos FROM l WHERE (contains(line, '±') AND regexp_matches(line, '[0-9]')) OR len(regexp_extract_all(line, '[0-9]+\.[0-9]+')) >= 2 OR len(list_distinct(regexp_extract_all(line, '(?i)({P.METRICS})', 1))) >= 2""")
def table_rows(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).where(P.table_row(F.col("line"))).select("doc_id", "pos")


@query(rf"""WITH {LINES},
t AS (SELECT doc_id, pos, CASE pos % 2 WHEN 0 THEN pos || '. In ' ELSE '' END || {STRIP.format("line")} AS t FROM l),
c AS (SELECT *, len(list_filter(string_split_regex(t, '\s+'), lambda x: x <> '')) AS n FROM t)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (t = '' OR (regexp_matches(t, '^[0-9]+(\.[0-9]+)*[.\s]+(?i:{P.OPENERS})\s') AND n > 6)
  OR (NOT regexp_matches(t, '(?i)^([0-9]+|[IVXLC]+|[A-Z])\.?\s') AND t LIKE '%.' AND n > 10)) AS BIGINT) AS n_sentences FROM c GROUP BY doc_id""")
def body_sentences(spark: SparkSession, d: str) -> DataFrame:
    number = F.when(F.col("pos") % 2 == 0, F.concat(F.col("pos").cast("string"), F.lit(". In "))).otherwise("")
    title = F.concat(number, P.strip(F.col("line")))
    return lines(spark, d).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(P.body_sentence(title)).alias("n_sentences"))


@query(rf"""WITH a AS (SELECT item_id, list_filter(list_transform(string_split_regex(text, ';|,|\band\b'), lambda x: {STRIP.format("x")}), lambda x: x <> '') AS a FROM benchmark)
SELECT item_id, len(a) AS n, a[1] AS first, a[-1] AS last FROM a""")
def author_split(spark: SparkSession, d: str) -> DataFrame:
    a = read(spark, d, "benchmark").select("item_id", P.authors(F.col("text")).alias("a"))
    return a.select("item_id", F.size("a").cast("long").alias("n"), F.try_element_at("a", F.lit(1)).alias("first"), F.try_element_at("a", F.lit(-1)).alias("last"))


@query(rf"""WITH {LINES}
SELECT doc_id, md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT ((length(t) >= 15 AND len(regexp_extract_all(t, '[0-9]+\.[0-9]+')) >= 3 AND len(regexp_extract_all(t, '[0-9]')) > 0.25 * length(t))
  OR (len(regexp_extract_all(t, '(?i)(?:{P.HEADER_NAMES})')) >= 2 AND len(regexp_extract_all(t, '(?i)(?:{P.HEADER_NAMES})')) > 0.5 * greatest(1, len(regexp_extract_all(t, '[A-Za-z0-9]+')))))), '')) AS digest FROM (SELECT *, {STRIP.format("line")} AS t FROM l) GROUP BY doc_id""")
def table_row_strip(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.md5(P.without_table_rows(F.col("text")).cast("binary")).alias("digest"))


TITLES = "t AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages)"
WORDS = "[A-Za-z][A-Za-z0-9-]*"
COMMON = ", ".join(f"'{w}'" for w in P.COMMON_TITLE_WORDS)
NAMING = rf"""list_distinct(list_filter(list_transform(flatten(list_transform(regexp_extract_all(title, '{WORDS}'), lambda w: CASE WHEN regexp_matches(w, '^[A-Z][A-Z0-9]*-') THEN list_concat([w], string_split(w, '-')) ELSE [w] END)), lambda w: lower(w)), lambda w: length(w) >= 4 AND w NOT IN ({COMMON})))"""


def titles(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query(rf"""WITH {TITLES}
SELECT page_id, len({NAMING}) AS n_words, lower(array_to_string(list_transform(list_filter(flatten(list_transform(regexp_extract_all(title, '{WORDS}'), lambda w: string_split(w, '-'))), lambda p: regexp_matches(p, '^[A-Za-z]')), lambda p: p[1]), '')) AS initials FROM t""")
def title_initials(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("title")
    return titles(spark, d).select("page_id", F.size(P.title_words(t)).cast("long").alias("n_words"), P.title_initials(t).alias("initials"))


@query(rf"""WITH {TITLES}, w AS (SELECT page_id, unnest({NAMING}) AS word FROM t)
SELECT item_id AS query_id, count(DISTINCT page_id) AS n, min(page_id) AS first_page FROM benchmark JOIN w ON contains(lower(text), word) GROUP BY item_id""")
def title_mentions(spark: SparkSession, d: str) -> DataFrame:
    asked = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    found = matching.title_mentions(asked, titles(spark, d).withColumnRenamed("page_id", "paper_id"))
    return found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("paper_id").alias("first_page"))


@query(f"""WITH {TITLES}, n AS (SELECT DISTINCT lower(title) AS name FROM t WHERE length(title) >= 4), z AS (SELECT unnest([4, 3, 2]) AS size),
s AS (SELECT part, min(name) AS name, side, size FROM (SELECT left(name, size) AS part, name, 0 AS side, size FROM n, z UNION ALL SELECT right(name, size), name, 1, size FROM n, z) GROUP BY part, side, size HAVING count(*) = 1),
w AS (SELECT item_id, size, pos, substring(text, pos, size) AS part FROM (SELECT item_id, text, size, unnest(generate_series(1, length(text) - size + 1)) AS pos FROM benchmark, z))
SELECT item_id AS query_id, name FROM w JOIN s USING (part, size) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY size DESC, pos, side) = 1""")
def field_affix_match(spark: SparkSession, d: str) -> DataFrame:
    asked = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    names = titles(spark, d).where(F.length("title") >= 4).select(F.lower("title").alias("name")).distinct()
    return matching.unique_affix_match(asked, names)


@query("""SELECT o_orderkey, CAST(CASE WHEN o_custkey % 40 <= 0 THEN 0 ELSE greatest(1, least(3, 20000 // ((o_custkey % 40) * 800))) END AS INTEGER) AS chunks,
CASE WHEN TRY_CAST(CASE o_orderkey % 3 WHEN 0 THEN 'no' ELSE CAST(1890 + o_custkey % 300 AS VARCHAR) END AS INTEGER) BETWEEN 1900 AND 2100 THEN TRY_CAST(CASE o_orderkey % 3 WHEN 0 THEN 'no' ELSE CAST(1890 + o_custkey % 300 AS VARCHAR) END AS INTEGER) END AS year,
CASE WHEN o_orderkey % 7 = o_custkey % 7 THEN CAST(o_orderkey % 7 AS VARCHAR) ELSE (o_orderkey % 7) || '-' || (o_custkey % 7) END AS page_label FROM orders""")
def plan_and_labels(spark: SparkSession, d: str) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    y = F.when(key % 3 == 0, "no").otherwise((cust % 300 + 1890).cast("string"))
    return read(spark, d, "orders").select("o_orderkey", P.evidence_plan(cust % 40).alias("chunks"), P.year(y).alias("year"), P.page_label(key % 7, cust % 7).alias("page_label"))


@query(rf"""WITH f AS (SELECT conv_id, turn, string_split({STRIP.format("text")}, chr(10))[1] AS line FROM conversations),
c AS (SELECT conv_id, turn, {STRIP.format("regexp_replace(line, '^[" + '"' + r"''`\[(]+|[" + '"' + r"''`\]).,;:!?]+$', '', 'g')")} AS label FROM f)
SELECT conv_id, turn, CASE WHEN label = '' THEN 'other' ELSE label END AS label FROM c""")
def field_labels(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "conversations").select("conv_id", "turn", P.field_label(F.col("text")).alias("label"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)
SELECT a.vec_id, round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 4) AS cosine FROM v a JOIN v b ON b.vec_id = a.vec_id + 1""")
def cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    v = read(spark, d, "embeddings")
    after = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return v.join(after, "vec_id").select("vec_id", P.cosine(F.col("embedding"), F.col("other")).alias("cosine"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, CAST(json_extract(props, '$.k') AS INTEGER) BETWEEN 0 AND 19 AND event_type IN ('click', 'view', 'purchase') AS valid,
'event: ' || event_type || chr(10) || 'data: {"event_id":' || event_id || '}' || chr(10) || chr(10) AS frame FROM events""")
def grade_rows(spark: SparkSession, d: str) -> DataFrame:
    noisy = F.concat(F.lit("```json\n"), "props", F.lit("\n```"))
    e = read(spark, d, "events").withColumn("k", P.json_object(noisy, "k int")["k"])
    valid = F.col("k").between(0, 19) & F.col("event_type").isin("click", "view", "purchase")
    return e.select("event_id", "k", valid.alias("valid"), P.event_frame(F.col("event_type"), F.struct("event_id")).alias("frame"))


@query(rf"""WITH s AS (SELECT item_id, CASE item_id % 4 WHEN 0 THEN '2.1 ' WHEN 1 THEN 'IV. ' WHEN 2 THEN 'B. ' ELSE ' ' END || text AS t FROM benchmark)
SELECT item_id, replace(lower(coalesce(nullif({STRIP.format("regexp_replace(regexp_replace(regexp_replace(" + STRIP.format("t") + r", '^[0-9]+(\.[0-9]+)*[.、]?\s*', ''), '(?i)^[IVXLC]+[.、]\s*', ''), '^[A-Z][.、]\s*', '')")}, ''), 'other')), ' ', '_') AS slug FROM s""")
def section_slugs(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("item_id") % 4
    number = F.when(m == 0, "2.1 ").when(m == 1, "IV. ").when(m == 2, "B. ").otherwise(" ")
    return read(spark, d, "benchmark").select("item_id", P.slug(F.concat(number, "text")).alias("slug"))


@query("""WITH p AS (SELECT page_id, url, url || CASE page_id % 4 WHEN 0 THEN '.PDF' WHEN 1 THEN '.html' WHEN 2 THEN '.docx' ELSE '' END AS path FROM pages)
SELECT page_id, CASE WHEN lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) IN ('txt', 'md', 'pdf', 'html', 'htm') THEN lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) END AS kind,
CASE WHEN page_id % 5 IN (1, 2) THEN 'open' WHEN page_id % 3 = 0 THEN 'open' WHEN page_id % 5 = 0 THEN 'closed' END AS access, page_id % 4 > 0 OR page_id % 3 = 1 AS published,
'[file:' || page_id || '] [library:' || (page_id % 7) || '] ' || url AS indexed FROM p""")
def paper_status(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("page_id")
    path = F.concat("url", F.when(i % 4 == 0, ".PDF").when(i % 4 == 1, ".html").when(i % 4 == 2, ".docx").otherwise(""))
    said = F.when(i % 5 == 0, "closed").when(i % 5 == 1, "green")
    access = P.access_status(i % 5 == 2, said, F.lit(None).cast("boolean"), i % 3 == 0)
    venue, doi = F.when(i % 4 > 0, "venue"), F.lit("10.1/x")
    kind = F.when(i % 3 == 1, "article").otherwise("preprint")
    return read(spark, d, "pages").select("page_id", P.file_kind(path).alias("kind"), access.alias("access"), P.published(venue, doi, kind).alias("published"), P.indexed_text(i.cast("string"), i % 7, F.col("url")).alias("indexed"))


# --- venues ------------------------------------------------------------------

LEVELS = " ".join(f"WHEN key IN ({', '.join(repr(k) for k in keys)}) THEN '{v}'" for v, keys in V.EXACT.items())
LEVELS += " " + " ".join(f"WHEN contains(key, '{k}') THEN '{v}'" for k, v in V.inside(V.SHORT) + V.inside(V.FULL))
ROUTES = " ".join(f"WHEN {' OR '.join(f'''contains(key, '{k}')''' for k in keys)} THEN '{s}'" for s, keys in V.SOURCES.items())
NAMED = "CASE page_id % 5 WHEN 0 THEN 'Pattern Recognition' WHEN 1 THEN 'Proc. NAACL-HLT 2021' WHEN 2 THEN 'NeurIPS' ELSE '' END"


@query(rf"""WITH {TITLES}, k AS (SELECT page_id, regexp_replace(lower({NAMED} || title), '[^a-z0-9]', '', 'g') AS key FROM t)
SELECT page_id, CASE {LEVELS} END AS level, CASE {ROUTES} END AS source FROM k""")
def venue_levels(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("page_id") % 5
    name = F.concat(F.when(m == 0, "Pattern Recognition").when(m == 1, "Proc. NAACL-HLT 2021").when(m == 2, "NeurIPS").otherwise(""), "title")
    return titles(spark, d).select("page_id", V.venue_level(name).alias("level"), V.open_source(name).alias("source"))


# --- outlines ----------------------------------------------------------------

OUTLINE = "o AS (SELECT l_orderkey AS k, l_linenumber AS ordinal, min(l_partkey) AS p, CAST(min(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY ALL)"
TITLE = "CASE p % 3 WHEN 0 THEN q || '. Method' WHEN 1 THEN 'More' ELSE 'Where little meets' END"


#: Lines in a part of an outline whose pages are listed: each gives several rows, so the parts' number follows the lines.
OUTLINE_LINES = 250_000


def order_outline(spark: SparkSession, d: str, spread: bool = False) -> DataFrame:
    rows = read(spark, d, "lineitem")
    if spread:  # by the key of all later steps, which then need no other exchange
        rows = rows.repartition(max(1, -(-rows.count() // OUTLINE_LINES)), "l_orderkey")
    rows = rows.groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("ordinal"))
    return rows.agg(F.min("l_partkey").alias("p"), F.min("l_quantity").cast("long").alias("q"))


@query(f"""WITH {OUTLINE}, h AS (SELECT k, ordinal, ordinal // 2 + 1 AS page, p % 3 AS off FROM o),
n AS (SELECT *, lead(page) OVER w AS np, lead(off) OVER w AS no FROM h WINDOW w AS (PARTITION BY k ORDER BY ordinal))
SELECT k, ordinal, CAST(greatest(page, CASE WHEN np IS NULL THEN 9 WHEN np > page AND no > 0 THEN np ELSE np - 1 END) AS BIGINT) AS page_end FROM n""")
def section_page_ends(spark: SparkSession, d: str) -> DataFrame:
    h = order_outline(spark, d).selectExpr("k", "ordinal", "ordinal div 2 + 1 AS page", "p % 3 AS offset", "9L AS last_page")
    return outline.section_ends(h, "k").select("k", "ordinal", "page_end")


@query(f"""WITH {OUTLINE}, h AS (SELECT k, ordinal, CASE p % 3 WHEN 0 THEN 'experiments' WHEN 1 THEN 'discussion' ELSE 'method' END AS norm, q % 2 = 0 AS numbered, q % 3 + 1 AS level FROM o),
t AS (SELECT *, (SELECT arg_max(x.norm, x.ordinal) FROM h x WHERE x.k = h.k AND x.ordinal < h.ordinal AND x.level = 1) AS top FROM h)
SELECT k, ordinal, CASE WHEN norm = 'discussion' AND NOT numbered AND top IN ('experiments', 'results') THEN 2 ELSE level END AS new_level FROM t""")
def demoted_discussions(spark: SparkSession, d: str) -> DataFrame:
    norm = F.when(F.col("p") % 3 == 0, "experiments").when(F.col("p") % 3 == 1, "discussion").otherwise("method")
    h = order_outline(spark, d).select("k", "ordinal", norm.alias("norm"), (F.col("q") % 2 == 0).alias("numbered"), (F.col("q") % 3 + 1).alias("level"))
    return outline.demote_discussions(h, "k").select("k", "ordinal", "new_level")


@query(rf"""WITH {OUTLINE}, h AS (SELECT k, ordinal, {TITLE} AS t, ordinal // 2 AS page FROM o),
g AS (SELECT *, lag(t) OVER w AS u, lag(page) OVER w AS up FROM h WINDOW w AS (PARTITION BY k ORDER BY ordinal))
SELECT k, ordinal, coalesce(up = page AND length(u) < 60 AND length(t) <= 12 AND NOT regexp_matches(u, '[.:;]$') AND regexp_matches(t, '^[A-Za-z]'), FALSE) AS split_title,
coalesce(TRY_CAST(regexp_extract(t, '^([0-9]+)[.]', 1) AS INTEGER) - TRY_CAST(regexp_extract(u, '^([0-9]+)[.]', 1) AS INTEGER) > 1, FALSE) AS number_jump FROM g""")
def heading_issues(spark: SparkSession, d: str) -> DataFrame:
    h = order_outline(spark, d).select("k", "ordinal", F.expr(TITLE).alias("title"), F.expr("ordinal div 2").alias("page"), F.lit(1).alias("level"))
    return outline.heading_issues(h, "k").select("k", "ordinal", "split_title", "number_jump")


PAGES = f"""WITH {OUTLINE}, s AS (SELECT k, ordinal, 's' || p AS title, ordinal AS page_start, ordinal + q % 3 AS page_end FROM o),
g AS (SELECT k, unnest(generate_series(1, 9)) AS page FROM (SELECT DISTINCT k FROM o))"""


def sections_and_pages(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = order_outline(spark, d, spread=True)
    s = o.select("k", "ordinal", F.concat(F.lit("s"), F.col("p").cast("string")).alias("title"), F.col("ordinal").cast("long").alias("page_start"), (F.col("ordinal") + F.col("q") % 3).alias("page_end"))
    return s, o.select("k").distinct().select("k", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(9).cast("long"))).alias("page"))


@query(f"""{PAGES} SELECT g.k, page, coalesce(arg_max(title, ordinal), 'whole text') AS title FROM g LEFT JOIN s ON s.k = g.k AND page BETWEEN page_start AND page_end GROUP BY g.k, page""")
def section_of_pages(spark: SparkSession, d: str) -> DataFrame:
    s, pages = sections_and_pages(spark, d)
    return outline.section_of_pages(pages, s, "k")


@query(f"""{PAGES} SELECT g.k, page, arg_min(ordinal, CASE WHEN page_start = page THEN ordinal ELSE 100 + ordinal END) AS owner FROM g LEFT JOIN s ON s.k = g.k AND page BETWEEN page_start AND page_end GROUP BY g.k, page""")
def owner_of_pages(spark: SparkSession, d: str) -> DataFrame:
    s, pages = sections_and_pages(spark, d)
    return outline.owner_of_pages(pages, s, "k")


@query(f"""WITH RECURSIVE {OUTLINE}, r AS (SELECT k, ordinal, p % 2 AS label, q, row_number() OVER (PARTITION BY k ORDER BY ordinal) AS i FROM o),
f AS (SELECT k, ordinal, label, q AS total, i, 0 AS unit FROM r WHERE i = 1 UNION ALL
  SELECT r.k, r.ordinal, r.label, CASE WHEN r.label = f.label AND f.total + r.q + 1 <= 60 THEN f.total + r.q + 1 ELSE r.q END, r.i, CASE WHEN r.label = f.label AND f.total + r.q + 1 <= 60 THEN f.unit ELSE f.unit + 1 END FROM f JOIN r ON r.k = f.k AND r.i = f.i + 1)
SELECT k, ordinal, unit FROM f""")
def merge_pieces(spark: SparkSession, d: str) -> DataFrame:
    o = order_outline(spark, d).select("k", "ordinal", (F.col("p") % 2).alias("label"), F.col("q").alias("size"))
    return folds.merge_pieces(o, "k", ["ordinal"], "label", "size", 60).select("k", "ordinal", "unit")


@query(f"""WITH RECURSIVE {OUTLINE}, r AS (SELECT k, ordinal, q, row_number() OVER (PARTITION BY k ORDER BY ordinal) AS i FROM o),
f AS (SELECT k, ordinal, i, CASE WHEN q <= 50 THEN q ELSE 0 END AS used, q <= 50 AS taken FROM r WHERE i = 1 UNION ALL
  SELECT r.k, r.ordinal, r.i, CASE WHEN f.used + r.q <= 50 THEN f.used + r.q ELSE f.used END, f.used + r.q <= 50 FROM f JOIN r ON r.k = f.k AND r.i = f.i + 1)
SELECT k, ordinal, taken FROM f""")
def evidence_fill(spark: SparkSession, d: str) -> DataFrame:
    o = order_outline(spark, d).select("k", "ordinal", F.col("q").alias("size"))
    return folds.fill_budget(o, "k", ["ordinal"], "size", 50).select("k", "ordinal", "taken")


@query(f"""WITH RECURSIVE {OUTLINE}, r AS (SELECT k, q, row_number() OVER (PARTITION BY k ORDER BY q, ordinal) AS i FROM o),
f AS (SELECT k, q, i, q AS last, TRUE AS stays FROM r WHERE i = 1 UNION ALL
  SELECT r.k, r.q, r.i, CASE WHEN r.q - f.last < 4 THEN f.last ELSE r.q END, r.q - f.last >= 4 FROM f JOIN r ON r.k = f.k AND r.i = f.i + 1)
SELECT k, count(*) AS n, CAST(count(*) FILTER (stays) AS BIGINT) AS n_stay FROM f GROUP BY k""")
def nearby_marks(spark: SparkSession, d: str) -> DataFrame:
    marks = folds.drop_nearby(order_outline(spark, d).select("k", "ordinal", "q"), "k", ["q", "ordinal"], "q", 4)
    return marks.groupBy("k").agg(F.count("*").alias("n"), F.count_if("stays").alias("n_stay"))


@query(f"""WITH {OUTLINE} SELECT k, ordinal, p % 2 AS label, CAST(row_number() OVER (PARTITION BY k, p % 2 ORDER BY ordinal) - 1 AS INTEGER) AS block FROM o""")
def block_numbers(spark: SparkSession, d: str) -> DataFrame:
    o = order_outline(spark, d).select("k", "ordinal", (F.col("p") % 2).alias("label"))
    return o.withColumn("block", F.row_number().over(W.partitionBy("k", "label").orderBy("ordinal")) - 1)


@query("""WITH c AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)
SELECT conv_id, n, CAST(CASE WHEN n >= 4 THEN greatest(2, n // 2) ELSE 0 END AS BIGINT) AS folded, CAST(n - CASE WHEN n >= 4 THEN greatest(2, n // 2) ELSE 0 END AS BIGINT) AS kept FROM c""")
def window_compression(spark: SparkSession, d: str) -> DataFrame:
    return outline.compress_window(read(spark, d, "conversations"), "conv_id", "turn")


@query("""WITH c AS (SELECT doc_id, text, unnest(generate_series(0, CAST(ceil(greatest(length(text) - 500, 0) / 450.0) AS BIGINT))) AS i FROM documents WHERE length(text) > 0)
SELECT doc_id, CAST(min(i) AS INTEGER) AS first, CAST(max(i) AS INTEGER) AS last, md5(substring(arg_min(text, i), 1, 500)) AS first_raw FROM c GROUP BY doc_id""")
def chunk_ends(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    ends = chunking.chunk_text(docs).groupBy("doc_id").agg(F.min("chunk_index").alias("first"), F.max("chunk_index").alias("last"), F.min_by(F.struct("start_char", "end_char"), "chunk_index").alias("at"))
    raw = F.substring(F.col("text"), F.col("at.start_char") + 1, F.col("at.end_char") - F.col("at.start_char"))
    return ends.join(docs, "doc_id").select("doc_id", "first", "last", F.md5(raw.cast("binary")).alias("first_raw"))
