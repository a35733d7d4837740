"""Queries on replies and payloads in JSON, file names, links, captions and citations.

Replies are put together from the tables' rows; the SQL states what must come
out of them from the rows alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colophon.functions import papers as P
from colophon.functions import payloads as J
from colophon.operators import citations
from colophon.plans.base import query, read
from colophon.plans.paper_queries import LINES, STRIP, lines


def _text(*parts) -> F.Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@query("SELECT conv_id, turn, turn AS index, role AS caption FROM conversations")
def caption_replies(spark: SparkSession, d: str) -> DataFrame:
    turn, role = F.col("turn"), F.col("role")
    reply = _text('```json\n[{"index": ', turn, ', "caption": " ', role, ' "}, {"caption": "no index"}, {"index": 7, "caption": ""}, {"index": null, "caption": "x"}]\n```')
    rows = read(spark, d, "conversations").select("conv_id", "turn", F.explode(J.captions(reply)).alias("x"))
    return rows.select("conv_id", "turn", "x.*")


@query("""SELECT conv_id, turn, 0 AS pos, role AS title, CASE WHEN turn = 0 THEN 1 ELSE turn END AS level, conv_id + 1 AS page_start, 1 AS page_end FROM conversations
UNION ALL SELECT conv_id, turn, 1, 'last', 1, 1, 3 FROM conversations""")
def outline_replies(spark: SparkSession, d: str) -> DataFrame:
    reply = _text('Here: [{"title": "', F.col("role"), ' ", "level": ', F.col("turn"), ', "page_start": ', F.col("conv_id") + 1, '}, {"title": ""}, {"level": 2}, {"title": "last", "page_end": 3}] done')
    rows = read(spark, d, "conversations").select("conv_id", "turn", F.posexplode(J.outline_items(reply)).alias("pos", "x"))
    return rows.select("conv_id", "turn", "pos", "x.*")


@query("""SELECT doc_id, coalesce(lang, '') AS field, CASE WHEN lang IS NOT NULL AND 1890 + doc_id % 300 <= 2100 AND 1890 + doc_id % 300 >= 1900 THEN CAST(1890 + doc_id % 300 AS INTEGER) END AS year_min,
CAST(NULL AS INTEGER) AS year_max, CASE WHEN lang IS NULL THEN '' ELSE lang END AS authors, CASE WHEN lang IS NULL THEN '' ELSE 'a|' || lang END AS keywords, '' AS language FROM documents""")
def filter_replies(spark: SparkSession, d: str) -> DataFrame:
    reply = _text('I think {"field": " ', F.col("lang"), '", "year_min": "', 1890 + F.col("doc_id") % 300, '", "year_max": 99, "authors": "', F.col("lang"), '", "keywords": ["a", " ", null, "', F.col("lang"), ' "], "language": null} {"field": "second"}')
    rows = read(spark, d, "documents").select("doc_id", J.filter_of_reply(reply).alias("x")).select("doc_id", "x.*")
    return rows.withColumn("authors", F.array_join("authors", "|")).withColumn("keywords", F.array_join("keywords", "|"))


@query("""SELECT doc_id, 'about ' || doc_id AS summary, 'good|' || doc_id AS strengths, 0 AS n_minor, CAST(CASE doc_id % 4 WHEN 0 THEN doc_id * 1.0 WHEN 1 THEN 7.5 END AS DOUBLE) AS score, 'high' AS novelty, '' AS writing FROM documents""")
def reviews(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 4
    score = F.when(k == 0, F.col("doc_id").cast("string")).when(k == 1, "7.5").when(k == 2, "true").otherwise('"8"')
    payload = _text('{"summary": " about ', F.col("doc_id"), ' ", "strengths": ["good", "  ", "', F.col("doc_id"), ' "], "minor_issues": null, "ratings": {"novelty": " high"}, "score": ', score, "}")
    x = read(spark, d, "documents").select("doc_id", J.review(payload).alias("x"))
    return x.select("doc_id", "x.summary", F.array_join("x.strengths", "|").alias("strengths"), F.size("x.minor_issues").alias("n_minor"), F.col("x.score").cast("double").alias("score"), "x.ratings.novelty", "x.ratings.writing")


@query("""SELECT conv_id, turn, '## Slide 1: ' || role || chr(10) || '- one' || chr(10) || '- ' || turn || chr(10) || '  (notes) say' || chr(10) || '## Slide 2: end' AS markdown FROM conversations""")
def slides(spark: SparkSession, d: str) -> DataFrame:
    payload = _text('{"slides": [{"title": " ', F.col("role"), '", "bullets": ["one", " ", "', F.col("turn"), ' "], "notes": " say "}, {"title": " ", "bullets": ["lost"]}, {"title": "end"}]}')
    return read(spark, d, "conversations").select("conv_id", "turn", J.slides_markdown(payload).alias("markdown"))


@query("""SELECT doc_id, md5('## background' || chr(10) || chr(10) || left(text, 50) || chr(10) || chr(10) || '## motivation' || chr(10) || chr(10) || coalesce(lang, 'no evidence') || chr(10) || chr(10)
|| '## existing_problems' || chr(10) || chr(10) || 'no evidence' || chr(10) || chr(10) || '## solution' || chr(10) || chr(10) || coalesce(source, 'no evidence') || chr(10) || chr(10) || '## contributions' || chr(10) || chr(10) || 'no evidence' || chr(10) || chr(10) || '## terms' || chr(10) || chr(10) || 'no evidence') AS digest FROM documents""")
def report_blocks(spark: SparkSession, d: str) -> DataFrame:
    report = F.create_map(F.lit("background"), F.substring("text", 1, 50), F.lit("motivation"), F.col("lang"), F.lit("solution"), F.col("source"))
    return read(spark, d, "documents").select("doc_id", F.md5(J.report_markdown(report).cast("binary")).alias("digest"))


@query("""SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN role || ' ' || turn WHEN 1 THEN role || turn ELSE 'plain ' || role END AS text FROM conversations""")
def reply_texts(spark: SparkSession, d: str) -> DataFrame:
    role, turn = F.col("role"), F.col("turn")
    reply = F.when(turn % 3 == 0, _text(' {"content": " ', role, " ", turn, ' ", "x": 1} ')).when(turn % 3 == 1, _text('[{"text": "', role, '"}, {"type": "image"}, {"text": "', turn, '"}]')).otherwise(_text("  plain ", role, "\n"))
    return read(spark, d, "conversations").select("conv_id", "turn", J.reply_text(reply).alias("text"))


@query(r"""WITH f AS (SELECT page_id, regexp_replace(regexp_replace(string_split(string_split(url, '/')[-1], '?')[1], '[^A-Za-z0-9._-]', '_', 'g'), '[ .]+$', '') AS name FROM pages),
g AS (SELECT page_id, CASE WHEN name = '' THEN 'paper.pdf' ELSE name END AS name FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY page_id) - 1 AS k FROM g)
SELECT page_id, CASE WHEN k = 0 THEN name WHEN contains(name, '.') THEN regexp_replace(name, '\.[^.]*$', '') || '_' || k || regexp_extract(name, '\.[^.]*$') ELSE name || '_' || k END AS name FROM r""")
def file_names(spark: SparkSession, d: str) -> DataFrame:
    """File names from URLs; of equal ones the first keeps its name, the others are numbered before the extension."""
    rows = read(spark, d, "pages").select("page_id", J.url_file_name(F.col("url")).alias("name"))
    k = (F.row_number().over(W.partitionBy("name").orderBy("page_id")) - 1).cast("string")
    stem, ext = F.regexp_replace("name", r"\.[^.]*$", ""), F.regexp_extract("name", r"\.[^.]*$", 0)
    return rows.select("page_id", F.when(k == "0", F.col("name")).otherwise(F.concat(stem, F.lit("_"), k, ext)).alias("name"))


@query(r"""WITH t AS (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, split_part(split_part(url, '//', 2), '/', 1) AS host FROM pages)
SELECT page_id, host || '_' || CASE WHEN title = '' THEN 'paper' ELSE left(regexp_replace(title, '[^A-Za-z0-9._-]+', '_', 'g'), 80) END || '.pdf' AS name FROM t""")
def source_names(spark: SparkSession, d: str) -> DataFrame:
    host = F.split_part(F.split_part("url", F.lit("//"), F.lit(2)), F.lit("/"), F.lit(1))
    return read(spark, d, "pages").select("page_id", J.source_file_name(F.regexp_extract("html", "<title>([^<]*)</title>", 1), host).alias("name"))


ANCHOR = '<a href="([^"]*)"[^>]*>([^<]*)</a>'


@query(f"""WITH a AS (SELECT page_id, regexp_extract_all(html, '{ANCHOR}', 1) AS href, regexp_extract_all(html, '{ANCHOR}', 2) AS title FROM pages)
SELECT page_id, CAST(unnest(generate_series(1, len(href))) - 1 AS INTEGER) AS pos, unnest(href) AS href, unnest(title) AS title FROM a""")
def page_anchors(spark: SparkSession, d: str) -> DataFrame:
    """An index page's entries in their order."""
    pairs = F.arrays_zip(F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(1)).alias("href"), F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(2)).alias("title"))
    return read(spark, d, "pages").select("page_id", F.posexplode(pairs).alias("pos", "x")).select("page_id", "pos", "x.href", "x.title")


@query(f"""WITH a AS (SELECT page_id, regexp_extract_all(html, '{ANCHOR}', 1) AS l FROM pages)
SELECT page_id, coalesce(list_filter(l, lambda x: regexp_matches(x, '(?i)und|la$'))[1], list_filter(l, lambda x: contains(x, 't'))[1]) AS link FROM a""")
def first_links(spark: SparkSession, d: str) -> DataFrame:
    links = F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(1))
    return read(spark, d, "pages").select("page_id", J.first_link(links, ("(?i)und|la$", "t")).alias("link"))


CAPTIONS = rf"""c AS (SELECT doc_id, pos, CASE pos % 6 WHEN 0 THEN 'Figure ' || pos || ': ' WHEN 1 THEN 'Table IV. ' WHEN 2 THEN 'Table ' || pos || ' ' WHEN 3 THEN 'fig.' || pos || 'a: ' WHEN 4 THEN regexp_replace(line, '\s+', '', 'g') ELSE '' END || line AS line FROM l)"""


def caption_lines(spark: SparkSession, d: str) -> DataFrame:
    pos = F.col("pos")
    front = F.when(pos % 6 == 0, _text("Figure ", pos, ": ")).when(pos % 6 == 1, "Table IV. ").when(pos % 6 == 2, _text("Table ", pos, " ")).when(pos % 6 == 3, _text("fig.", pos, "a: "))
    front = front.when(pos % 6 == 4, F.regexp_replace("line", r"\s+", "")).otherwise("")
    return lines(spark, d).select("doc_id", "pos", F.concat(front, "line").alias("line"))


@query(rf"""WITH {LINES}, {CAPTIONS}
SELECT doc_id, CAST(count(*) FILTER (regexp_matches(line, '{J.CAPTION}')) AS BIGINT) AS strict, CAST(count(*) FILTER (regexp_matches(line, '{J.LOOSE_TABLE}')) AS BIGINT) AS loose, CAST(count(*) FILTER (regexp_matches(line, '{J.GLUED}')) AS BIGINT) AS glued FROM c GROUP BY doc_id""")
def caption_kinds(spark: SparkSession, d: str) -> DataFrame:
    line = F.col("line")
    return caption_lines(spark, d).groupBy("doc_id").agg(*[F.count_if(line.rlike(p)).alias(n) for n, p in (("strict", J.CAPTION), ("loose", J.LOOSE_TABLE), ("glued", J.GLUED))])


@query(rf"""WITH {LINES}, {CAPTIONS}, n AS (SELECT *, CASE WHEN regexp_matches(line, '{J.CAPTION_NUMBER}') THEN coalesce(TRY_CAST(regexp_extract(line, '{J.CAPTION_NUMBER}', 1) AS INTEGER), 0) END AS number FROM c)
SELECT doc_id, number, CAST(pos AS INTEGER) AS pos FROM n WHERE number IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY number DESC, pos) = 1""")
def picked_captions(spark: SparkSession, d: str) -> DataFrame:
    """Of a text's labelled captions the one of the largest Arabic number, the first of equals."""
    rows = caption_lines(spark, d).select("doc_id", "pos", J.caption_number(F.col("line")).alias("number")).where("number IS NOT NULL")
    return rows.groupBy("doc_id").agg(F.max(F.struct("number", (-F.col("pos")).alias("back"))).alias("x")).select("doc_id", "x.number", (-F.col("x.back")).alias("pos"))


@query(rf"""SELECT doc_id, md5({STRIP.format("CASE doc_id % 3 WHEN 1 THEN 'middle.' || chr(10) || text ELSE text END")}) AS digest FROM documents""")
def page_prefixes(spark: SparkSession, d: str) -> DataFrame:
    """Page numbers and captions put before the texts go again."""
    k = F.col("doc_id") % 3
    front = F.when(k == 0, _text(F.col("doc_id"), "\n")).when(k == 1, _text(F.col("doc_id"), "\nFigure 3: what\nit shows.\nmiddle.\n")).otherwise(F.lit("Fig. 12. one line.\n"))
    return read(spark, d, "documents").select("doc_id", F.md5(J.without_page_prefix(F.concat(front, "text")).cast("binary")).alias("digest"))


@query("""WITH y AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN CAST(year(o_orderdate) AS INTEGER) END AS y FROM orders),
e AS (SELECT o_orderkey, unnest(CASE WHEN y IS NOT NULL THEN [y] ELSE [2001, 2000, 1999] END) AS y FROM y)
SELECT page, count(*) AS n FROM (SELECT 'CVPR' || y || '?day=all' AS page FROM e UNION ALL SELECT 'ICCV' || y || '?day=all' FROM e WHERE y % 2 = 1) GROUP BY page""")
def candidate_pages(spark: SparkSession, d: str) -> DataFrame:
    y = F.when(F.col("o_orderstatus") != "P", F.year("o_orderdate"))
    return read(spark, d, "orders").select(F.explode(J.conference_pages(y, 2001)).alias("page")).groupBy("page").agg(F.count("*").alias("n"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, 'AAAI-' || right(CAST(year(l_shipdate) AS VARCHAR), 2) || ' Tracks ' || l_linenumber AS label, CASE l_linenumber % 3 WHEN 0 THEN NULL WHEN 1 THEN 2000 + year(l_shipdate) % 100 ELSE 2001 END AS y,
CASE l_linenumber % 2 WHEN 0 THEN 'Proc. I.C.M.L. ' ELSE 'Proc. UAI ' END || year(l_shipdate) AS volume, CASE l_linenumber % 4 WHEN 0 THEN NULL ELSE year(o_orderdate) END AS vy FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT CAST(count(*) FILTER (y IS NULL OR 2000 + CAST(substring(label, 6, 2) AS INTEGER) = y) AS BIGINT) AS issues, CAST(count(*) FILTER (volume LIKE '%I.C.M.L.%' AND (vy IS NULL OR contains(volume, CAST(vy AS VARCHAR)))) AS BIGINT) AS volumes, count(*) AS n FROM l""")
def issues_and_volumes(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").join(read(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    k, y = F.col("l_linenumber"), F.year("l_shipdate")
    label = _text("AAAI-", F.right(y.cast("string"), F.lit(2)), " Tracks ", k)
    asked = F.when(k % 3 == 1, 2000 + y % 100).when(k % 3 == 2, 2001)
    volume = _text(F.when(k % 2 == 0, "Proc. I.C.M.L. ").otherwise("Proc. UAI "), y)
    return rows.agg(F.count_if(J.issue_of_year(label, asked)).alias("issues"), F.count_if(J.volume_of_year(volume, F.when(k % 4 != 0, F.year("o_orderdate")))).alias("volumes"), F.count("*").alias("n"))


CITED = r"""
k AS (SELECT doc_id AS chunk_id, source AS paper_id, doc_id % 9 AS lo, doc_id % 9 + doc_id % 3 AS hi, text FROM documents),
c AS (SELECT doc_id AS citation_id, CASE WHEN doc_id % 11 = 0 THEN 'x' ELSE source END AS asked_paper, source AS paper_id, CASE WHEN doc_id % 7 = 0 THEN -doc_id - 1 WHEN doc_id % 5 = 0 THEN doc_id + 1 ELSE doc_id END AS chunk_id,
  CASE doc_id % 4 WHEN 0 THEN NULL ELSE doc_id % 10 END AS page, CASE WHEN doc_id % 13 = 0 THEN ' - ' ELSE substring(text, 5, 60) || '...' END AS quote FROM documents),
j AS (SELECT c.*, k.paper_id AS owner, k.chunk_id AS hit, lo, hi, regexp_replace(lower(quote), '[^\p{L}\p{N}_]+', '', 'g') AS q, regexp_replace(lower(k.text), '[^\p{L}\p{N}_]+', '', 'g') AS b FROM c LEFT JOIN k ON k.chunk_id = c.chunk_id),
r AS (SELECT *, CASE WHEN paper_id IS DISTINCT FROM asked_paper THEN 'foreign_paper' WHEN hit IS NULL THEN 'missing_chunk' WHEN owner IS DISTINCT FROM asked_paper THEN 'foreign_chunk' WHEN q IS NULL OR q = '' OR NOT coalesce(contains(b, q), false) THEN 'quote_not_found' END AS bad FROM j)"""


def cited(spark: SparkSession, d: str) -> DataFrame:
    docs, i = read(spark, d, "documents"), F.col("doc_id")
    chunks = docs.select(i.alias("chunk_id"), F.col("source").alias("paper_id"), (i % 9).alias("page_start"), (i % 9 + i % 3).alias("page_end"), "text")
    asked = docs.select(
        i.alias("citation_id"), F.when(i % 11 == 0, "x").otherwise(F.col("source")).alias("asked_paper"), F.col("source").alias("paper_id"), F.when(i % 7 == 0, -i - 1).when(i % 5 == 0, i + 1).otherwise(i).alias("chunk_id"),
        F.when(i % 4 != 0, i % 10).alias("page"), F.when(i % 13 == 0, " - ").otherwise(_text(F.substring("text", 5, 60), "...")).alias("quote"),
    )
    return citations.validate(asked, chunks)


@query(f"""WITH {CITED} SELECT citation_id, bad IS NULL AS valid, CASE WHEN bad IS NULL THEN CASE WHEN page BETWEEN lo AND hi THEN page ELSE lo END END AS page,
coalesce(bad, CASE WHEN page BETWEEN lo AND hi THEN '' WHEN page IS NULL THEN 'page_inferred' ELSE 'page_corrected' END) AS reason FROM r""")
def citation_reasons(spark: SparkSession, d: str) -> DataFrame:
    return cited(spark, d).select("citation_id", "valid", "page", "reason")


@query(f"""WITH {CITED} SELECT asked_paper, count(*) AS n, CAST(count(*) FILTER (bad IS NULL) AS BIGINT) AS n_valid, CASE WHEN count(*) = count(*) FILTER (bad IS NULL) THEN 'verified' ELSE 'downgraded' END AS verdict FROM r GROUP BY asked_paper""")
def citation_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return citations.verdicts(cited(spark, d), "asked_paper", 0)


@query("""SELECT doc_id, 'about ' || doc_id AS background, 'no evidence' AS motivation, '[]' AS terms, doc_id || ':' || source || ':c' || doc_id AS citations FROM documents""")
def reports_of_replies(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    reply = _text('Here it is: {"report": {"background": "about ', i, '"}, "citations": [{"paper_id": "forged", "paper_title": "x", "chunk_id": "c', i, '", "quote": "q"}, {"chunk_id": "no quote"}, 5]} thanks')
    plain = F.replace(reply, F.lit(", 5]"), F.lit("]"))
    x = read(spark, d, "documents").select("doc_id", F.explode(F.array(J.report_of_reply(plain, i.cast("string"), F.col("source")))).alias("x"))
    cites = F.array_join(F.transform("x.citations", lambda c: F.concat_ws(":", c.paper_id, c.paper_title, c.chunk_id)), "|")
    return x.select("doc_id", "x.report.background", "x.report.motivation", "x.report.terms", cites.alias("citations"))


@query("""SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'Part ' || item_id WHEN 1 THEN 'Text ' || item_id END AS title, CASE item_id % 4 WHEN 0 THEN 2 ELSE 3 END AS level FROM benchmark WHERE item_id % 4 < 2""")
def layout_headings(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("item_id")
    block = F.when(i % 4 == 0, _text('{"type": "title", "content": {"title_content": "## Part ', i, '", "level": 2}}')).when(i % 4 == 1, _text('{"type": "text", "text": " # Text ', i, ' ", "text_level": 3}'))
    block = block.when(i % 4 == 2, '{"type": "text", "text": "no level"}').otherwise(_text('{"type": "title", "content": {"title_content": "', F.repeat(F.lit("x"), 121), '"}}'))
    rows = read(spark, d, "benchmark").select("item_id", F.explode(F.filter(F.transform(F.array(block), J.layout_heading), lambda h: h.isNotNull())).alias("h"))
    return rows.select("item_id", "h.title", "h.level")


@query("""SELECT conv_id, turn, CAST(conv_id AS INTEGER) AS paper_id, role AS section, CAST(turn + 1 AS INTEGER) AS page_start, CAST(turn + 1 AS INTEGER) AS page_end, 0 AS char_start, CAST(length(text) AS INTEGER) AS char_end, 'kept' AS note, CAST(conv_id AS VARCHAR) AS back FROM conversations""")
def chunk_mapping(spark: SparkSession, d: str) -> DataFrame:
    """A chunk's metadata to its fields, and the fields back into metadata."""
    meta = F.map_from_arrays(F.array(*[F.lit(k) for k in ("paper_id", "section", "page_start", "note")]), F.array(F.col("conv_id").cast("string"), F.col("role"), (F.col("turn") + 1).cast("string"), F.lit("kept")))
    rows = read(spark, d, "conversations").select("conv_id", "turn", J.chunk_of_metadata(meta, F.col("text")).alias("x")).select("conv_id", "turn", "x.*")
    return rows.withColumn("back", J.chunk_metadata(F.col("extra"))["paper_id"]).withColumn("note", F.col("extra")["note"]).drop("extra")
