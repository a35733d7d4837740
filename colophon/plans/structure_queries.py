"""Queries on sections in texts, windows within them, and boxes on pages.

Texts get numbers in front of their lines, so that they have headings; order
lines stand for boxes on pages, an order being a page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colophon.functions import headings as H
from colophon.functions import papers as P
from colophon.operators import chunking, regions, segments
from colophon.plans.base import query, read
from colophon.plans.paper_queries import STRIP

# --- sections ----------------------------------------------------------------

PAGES = r"""
pg AS (SELECT doc_id AS page, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE (i - 1) % 6 WHEN 1 THEN (i - 1) || '. ' WHEN 2 THEN chr(CAST(65 + (i - 1) % 26 AS INTEGER)) || '. ' WHEN 3 THEN 'IV. ' WHEN 4 THEN (i - 1) || '.' || ((i - 1) % 4) || ' ' WHEN 5 THEN 'Abstract ' ELSE '' END
  || CASE WHEN (i - 1) % 7 = 3 THEN 'INTRODUCTION' ELSE regexp_extract(x, '^\S*(?:\s+\S+){0,4}') END), chr(10)) AS text FROM documents)"""


def numbered_pages(spark: SparkSession, d: str) -> DataFrame:
    def line(x, i):
        m = i % 6
        front = F.when(m == 1, F.concat(i.cast("string"), F.lit(". "))).when(m == 2, F.concat(F.char(65 + i % 26), F.lit(". "))).when(m == 3, "IV. ")
        front = front.when(m == 4, F.concat(i.cast("string"), F.lit("."), (i % 4).cast("string"), F.lit(" "))).when(m == 5, "Abstract ").otherwise("")
        return F.concat(front, F.when(i % 7 == 3, "INTRODUCTION").otherwise(F.regexp_extract(x, r"^\S*(?:\s+\S+){0,4}", 0)))

    return read(spark, d, "documents").select(F.col("doc_id").alias("page"), F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("text"))


def _known(t: str) -> str:
    whens = " ".join(f"WHEN regexp_matches(regexp_replace({STRIP.format(t)}, '[:：]+$', ''), '(?i)^{H.NUMBER if numbered else ''}(?:{words})\\s*$') THEN '{name}'" for name, numbered, words in H.KNOWN_HEADINGS)
    return f"CASE {whens} END"


def _quoted(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


WORDS = r"len(list_filter(string_split_regex({}, '\s+'), lambda w: w <> ''))"
HEADINGS = rf"""
li AS (SELECT page, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM pg),
l0 AS (SELECT *, lead(line) OVER w AS next, coalesce(sum(length(line) + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
  regexp_replace(regexp_replace({STRIP.format("line")}, '\s+', ' ', 'g'), '[:：]+$', '') AS c FROM li WINDOW w AS (PARTITION BY page ORDER BY pos)),
l1 AS (SELECT *, CASE WHEN regexp_matches(c, '{H.LETTER}') THEN 'L' WHEN regexp_matches(c, '{H.ROMAN}') THEN 'R' WHEN regexp_matches(c, '{H.DECIMAL}') THEN 'D' END AS kind FROM l0),
l2 AS (SELECT *, CASE kind WHEN 'L' THEN regexp_extract(c, '{H.LETTER}', 1) WHEN 'R' THEN regexp_extract(c, '{H.ROMAN}', 1) WHEN 'D' THEN regexp_extract(c, '{H.DECIMAL}', 1) END AS number,
  trim(CASE kind WHEN 'L' THEN regexp_replace(regexp_extract(c, '{H.LETTER}', 2), '{H.TAIL}', '') WHEN 'R' THEN regexp_extract(c, '{H.ROMAN}', 2) WHEN 'D' THEN regexp_extract(c, '{H.DECIMAL}', 2) END) AS t FROM l1),
l3 AS (SELECT *, coalesce({_known("t")}, 'other') AS tn, {_known("c")} AS cn, {WORDS.format("t")} AS words, TRY_CAST(regexp_extract(number, '^([0-9]+)', 1) AS INTEGER) AS lead FROM l2),
l4 AS (SELECT *, t = '' OR words > 14 OR NOT regexp_matches(t, '^[A-Za-z\x{{4e00}}-\x{{9fff}}]') OR regexp_matches(t, '[\{{\[]')
  OR (kind = 'L' AND (contains(t, ',') OR regexp_matches(t, '\b(?:19|20)[0-9]{{2}}\b')))
  OR (kind = 'D' AND (coalesce(lead > 20, true) OR regexp_matches(number, '^0+$') OR (tn = 'other' AND (regexp_matches(t, '[,;]') OR regexp_matches(t, '^\p{{Ll}}')))
    OR (tn = 'other' AND NOT contains(number, '.') AND words < 2) OR lower(regexp_extract(t, '(\S+)$', 1)) IN ({_quoted(H.LAST_WORDS)}) OR regexp_matches(t, '^[A-Za-z]\s*[0-9]')
    OR regexp_matches(t, '\.\s+[A-Z]') OR (words > 8 AND lower(regexp_extract(t, '^(\S+)', 1)) IN ({_quoted(H.CLAUSE_WORDS)})))) AS refused FROM l3),
l5 AS (SELECT *, CASE WHEN c = '' OR regexp_matches(c, '(?i)\bet al\.?\s*$') THEN NULL
  WHEN regexp_matches(c, '{H.ABSTRACT}') THEN {{'title': regexp_extract(c, '{H.ABSTRACT}', 1), 'norm': 'abstract', 'level': 1, 'numbered': false}}
  WHEN regexp_matches(c, '{H.TOP_IN_LINE}') THEN {{'title': regexp_extract(c, '{H.TOP_IN_LINE}', 1) || '. ' || regexp_extract(c, '{H.TOP_IN_LINE}', 2), 'norm': coalesce({_known(f"regexp_extract(c, '{H.TOP_IN_LINE}', 2)")}, 'other'), 'level': 1, 'numbered': true}}
  WHEN regexp_matches(c, '{H.REFERENCES}') THEN {{'title': regexp_extract(c, '{H.REFERENCES}', 1), 'norm': 'references', 'level': 1, 'numbered': false}}
  WHEN length(c) > 120 THEN NULL
  WHEN kind IS NOT NULL THEN CASE WHEN NOT coalesce(refused, true) THEN {{'title': CASE kind WHEN 'L' THEN number || '. ' || t ELSE c END, 'norm': tn, 'level': CASE WHEN kind = 'L' THEN 2 WHEN kind = 'R' THEN 1 ELSE least(3, 1 + length(number) - length(replace(number, '.', ''))) END, 'numbered': true}} END
  WHEN cn IS NOT NULL THEN {{'title': c, 'norm': cn, 'level': 1, 'numbered': false}} END AS h FROM l4),
l6 AS (SELECT *, {STRIP.format("h.title")} AS ht FROM l5 WHERE h IS NOT NULL),
l7 AS (SELECT * FROM l6 WHERE NOT (ht = '' OR (regexp_matches(ht, '(?i)^[0-9]+(\.[0-9]+)*[.\s]+({P.OPENERS})\s') AND {WORDS.format("ht")} > 6) OR (NOT regexp_matches(ht, '(?i)^([0-9]+|[IVXLC]+|[A-Z])\.?\s') AND ht LIKE '%.' AND {WORDS.format("ht")} > 10))
  AND NOT (NOT h.numbered AND coalesce((contains(next, '±') AND regexp_matches(next, '[0-9]')) OR len(regexp_extract_all(next, '[0-9]+\.[0-9]+')) >= 2 OR len(list_distinct(regexp_extract_all(next, '(?i)({P.METRICS})', 1))) >= 2, false))),
l8 AS (SELECT *, max(h.numbered) OVER (PARTITION BY page) AS has_number FROM l7),
hd AS (SELECT page, pos, CAST(start AS BIGINT) + greatest(strpos(line, left(h.title, 1)) - 1, 0) AS "offset", h.title AS title, h.norm AS norm, h.level AS level, h.numbered AS numbered FROM l8 WHERE NOT has_number OR h.numbered OR h.norm IN ('abstract', 'references'))"""


@query(f"""WITH {PAGES},{HEADINGS} SELECT page, CAST(pos AS INTEGER) AS pos, CAST("offset" AS BIGINT) AS "offset", title, norm, CAST(level AS INTEGER) AS level, numbered FROM hd""")
def section_headings(spark: SparkSession, d: str) -> DataFrame:
    return segments.heading_lines(numbered_pages(spark, d)).withColumn("offset", F.col("offset").cast("long"))


@query(rf"""WITH {PAGES},{HEADINGS},
b AS (SELECT page, substring(text, 1, 200) AS abstract FROM pg WHERE page % 2 = 0),
e AS (SELECT page, -1 AS pos, 'Abstract' AS title, 'abstract' AS norm FROM b WHERE abstract <> '' AND page NOT IN (SELECT page FROM hd WHERE norm = 'abstract')),
u AS (SELECT page, pos, title, norm FROM hd UNION ALL SELECT * FROM e)
SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY pos) - 1 AS INTEGER) AS ordinal, title, norm FROM u""")
def sections_with_abstract(spark: SparkSession, d: str) -> DataFrame:
    pages = numbered_pages(spark, d)
    return segments.with_abstract(segments.heading_lines(pages), pages.where("page % 2 = 0").select("page", F.substring("text", 1, 200).alias("abstract")))


@query(rf"""WITH a AS (SELECT doc_id, coalesce(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '^\s*$'))[1], '') AS t FROM documents)
SELECT doc_id, regexp_replace(regexp_replace({STRIP.format("t")}, '\s+', ' ', 'g'), '^[ \t.:;,_-]+|[ \t.:;,_-]+$', '', 'g') AS title FROM a""")
def first_line_titles(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", H.first_line_title(F.col("text")).alias("title"))


@query(r"""WITH t AS (SELECT doc_id, 'x' || chr(10) || 'Abstract' || chr(10) || regexp_replace(text, '\. ', '.' || chr(10) || 'keywords a' || chr(10), 'g') || chr(10) || '1. Introduction' AS text FROM documents),
b AS (SELECT doc_id, regexp_extract(text, '(?is)^x\n\s*abstract\b(.*)$', 1) AS after FROM t),
c AS (SELECT doc_id, CASE WHEN regexp_matches(after, '(?i)(?:^|\n)\s*(?:[IVXLC0-9]+\.?\s+)?(?:introduction|index\s*terms|参考文献)\b') THEN left(after, length(after) - length(regexp_extract(after, '(?i)\n\s*1\. Introduction$'))) ELSE after END AS body FROM b),
d AS (SELECT doc_id, list_filter(list_transform(string_split(body, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '' AND NOT regexp_matches(x, '(?i)^(?:keywords?|article info|graphical abstract)\b')) AS l FROM c)
SELECT doc_id, md5(left(regexp_replace(regexp_replace(array_to_string(l, ' '), '\s+', ' ', 'g'), '^[^\p{L}\p{N}_]+', ''), 5000)) AS digest FROM d""")
def abstracts(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("x\nAbstract\n"), F.regexp_replace("text", r"\. ", ".\nkeywords a\n"), F.lit("\n1. Introduction"))
    stop = r"(?i)(?:^|\n)\s*(?:[IVXLC0-9]+\.?\s+)?(?:introduction|index\s*terms|参考文献)\b"
    return read(spark, d, "documents").select("doc_id", F.md5(H.abstract(text, stop=stop).cast("binary")).alias("digest"))


SEGMENTS = """
sg AS (SELECT pg.page, coalesce(title, 'whole text') AS section, coalesce("offset", 0) AS b, coalesce(lead("offset") OVER (PARTITION BY pg.page ORDER BY "offset"), length(text)) AS e FROM pg LEFT JOIN hd ON hd.page = pg.page)"""


@query(rf"""WITH {PAGES},{HEADINGS},{SEGMENTS},
r AS (SELECT page, section, b, substring(text, b + 1, e - b) AS raw FROM sg JOIN pg USING (page)),
s AS (SELECT page, section, {STRIP.format("raw")} AS body, b + length(raw) - length(regexp_replace(raw, '^\s+', '')) AS base FROM r),
k AS (SELECT *, unnest(generate_series(0, CAST(ceil(greatest(length(body) - 1000, 0) / 880.0) AS BIGINT))) * 880 AS pos0 FROM s WHERE body <> ''),
w AS (SELECT page, section, base + pos0 AS "begin", base + least(pos0 + 1000, length(body)) AS "end", {STRIP.format("substring(body, pos0 + 1, least(pos0 + 1000, length(body)) - pos0)")} AS content FROM k)
SELECT page, section, CAST("begin" AS BIGINT) AS "begin", CAST("end" AS BIGINT) AS "end", md5(content) AS digest, CAST(row_number() OVER (PARTITION BY page ORDER BY "begin", "end") - 1 AS INTEGER) AS ordinal FROM w WHERE content <> ''""")
def segment_windows(spark: SparkSession, d: str) -> DataFrame:
    pages = numbered_pages(spark, d)
    parts = segments.segments(pages, segments.heading_lines(pages))
    out = segments.segment_windows(pages, parts)
    return out.select("page", "section", F.col("begin").cast("long").alias("begin"), F.col("end").cast("long").alias("end"), F.md5(F.col("content").cast("binary")).alias("digest"), "ordinal")


@query(rf"""WITH {PAGES},{HEADINGS},{SEGMENTS},
k AS (SELECT page, unnest(generate_series(0, CAST(ceil(greatest(length(text) - 200, 0) / 150.0) AS BIGINT))) * 150 AS "begin", length(text) AS n FROM pg WHERE length(text) > 0),
c AS (SELECT page, "begin", least("begin" + 200, n) AS "end", (SELECT max_by(section, b) FROM sg WHERE sg.page = k.page AND b <= "begin" - 60) AS section FROM k)
SELECT c.page, c."begin" AS "begin", c."end" AS "end", c.section, sg.section AS "right" FROM c JOIN sg ON sg.page = c.page AND c."begin" >= b - 1 AND c."end" <= e + 1 WHERE c.section <> sg.section""")
def chunk_audit(spark: SparkSession, d: str) -> DataFrame:
    """Fixed windows, labelled with the section 60 characters before them, against the segments they lie in."""
    pages = numbered_pages(spark, d)
    parts = segments.segments(pages, segments.heading_lines(pages)).persist()
    chunks = chunking.chunk_text(pages.withColumnRenamed("page", "doc_id"), 200, 50).select(F.col("doc_id").alias("page"), F.col("start_char").cast("long").alias("begin"), F.col("end_char").cast("long").alias("end"))
    label = chunks.join(parts.select("page", "section", F.col("begin").alias("b")), "page").where("b <= begin - 60").groupBy("page", "begin", "end").agg(F.max_by("section", "b").alias("section"))
    return segments.wrong_sections(label, parts)


# --- boxes -------------------------------------------------------------------

BOXES = """bx AS (SELECT l_orderkey AS page, (l_partkey * 1000 + l_suppkey) * 10 + l_linenumber AS id, l_returnflag AS number, l_quantity * 15 AS x0, CAST(floor(l_extendedprice) AS BIGINT) % 800 AS y0, l_quantity * 15 + 20 + l_partkey % 200 AS x1, CAST(floor(l_extendedprice) AS BIGINT) % 800 + 5 + l_suppkey % 150 AS y1 FROM lineitem)"""


def boxes(spark: SparkSession, d: str) -> DataFrame:
    x, y = F.col("l_quantity") * 15, F.floor("l_extendedprice") % 800
    double = lambda c: c.cast("double")
    return read(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("page"), ((F.col("l_partkey") * 1000 + F.col("l_suppkey")) * 10 + F.col("l_linenumber")).alias("id"), F.col("l_returnflag").alias("number"),
        x.alias("x0"), double(y).alias("y0"), (x + 20 + F.col("l_partkey") % 200).alias("x1"), double(y + 5 + F.col("l_suppkey") % 150).alias("y1"),
    )


CORNERS = "CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1"


@query(f"""WITH {BOXES}
SELECT page, id, round(x0 / 1000 * 600, 4) AS x0, round(y0 / 1000.0 * 800, 4) AS y0, round(x1 / 1000 * 600, 4) AS x1, round(y1 / 1000.0 * 800, 4) AS y1 FROM bx
WHERE (x1 - x0) / 1000 >= 0.001 AND (y1 - y0) / 1000.0 >= 0.001 AND (x1 - x0) / 1000 * ((y1 - y0) / 1000.0) >= 0.002""")
def scaled_boxes(spark: SparkSession, d: str) -> DataFrame:
    out = regions.scaled(boxes(spark, d), 600, 800)
    return out.select("page", "id", *[F.round(c, 4).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query(f"""WITH RECURSIVE {BOXES},
pr AS (SELECT a.page, a.id AS a, b.id AS b FROM bx a JOIN bx b ON a.page = b.page AND a.number = b.number AND a.id <> b.id
  WHERE (greatest(0, a.y0 - b.y1, b.y0 - a.y1) <= 40 AND least(a.x1, b.x1) - greatest(a.x0, b.x0) > 5) OR (greatest(0, a.x0 - b.x1, b.x0 - a.x1) <= 8 AND least(a.y1, b.y1) - greatest(a.y0, b.y0) > 5)),
rc AS (SELECT page, id, id AS root FROM bx UNION SELECT rc.page, pr.b, rc.root FROM rc JOIN pr ON pr.page = rc.page AND pr.a = rc.id),
lb AS (SELECT page, id, min(root) AS region FROM rc GROUP BY ALL),
bs AS (SELECT page, id, {CORNERS} FROM bx)
SELECT page, region, count(*) AS n, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM lb JOIN bs USING (page, id) GROUP BY ALL""")
def joint_regions(spark: SparkSession, d: str) -> DataFrame:
    return regions.joint_regions(boxes(spark, d)).drop("number")


@query(f"""WITH {BOXES}, w AS (SELECT page, (x0 + x1) / 2 AS cx, (y0 + y1) / 2.0 AS cy FROM bx)
SELECT b.page, b.id AS box, count(*) AS n_words FROM bx b JOIN w ON w.page = b.page AND cx BETWEEN x0 - 0.5 AND x1 + 0.5 AND cy BETWEEN y0 - 0.5 AND y1 + 0.5 WHERE number = 'R' GROUP BY ALL HAVING count(*) >= 2""")
def region_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Boxes that hold the centres of two words or more; every box is a word too."""
    rows = boxes(spark, d)
    return regions.inside(rows, rows.where("number = 'R'")).where("n_words >= 2")


@query(f"""WITH RECURSIVE {BOXES}, o AS (SELECT page, id, x0, y0, row_number() OVER (PARTITION BY page ORDER BY y0, x0, id) AS k FROM (SELECT DISTINCT page, id, x0, y0 FROM bx)),
r AS (SELECT page, id, x0, k, 0 AS "row", y0 AS top FROM o WHERE k = 1
  UNION ALL SELECT o.page, o.id, o.x0, o.k, CASE WHEN abs(o.y0 - top) <= 2.5 THEN "row" ELSE "row" + 1 END, CASE WHEN abs(o.y0 - top) <= 2.5 THEN top ELSE o.y0 END FROM r JOIN o ON o.page = r.page AND o.k = r.k + 1)
SELECT page, id, "row", CAST(row_number() OVER (PARTITION BY page ORDER BY x0 >= 400, "row", x0, id) AS INTEGER) AS place FROM r""")
def word_rows(spark: SparkSession, d: str) -> DataFrame:
    words = boxes(spark, d).select("page", "id", "x0", "y0").distinct()
    return regions.reading_order(regions.word_rows(words), 800).select("page", "id", "row", "place")


@query(f"""WITH {BOXES}, s AS (SELECT page, CAST(y0 AS DOUBLE) AS y, number FROM bx), g AS (SELECT r.page, r.y, (SELECT count(*) FROM s WHERE s.page = r.page AND s.number = 'R' AND s.y < r.y) AS above FROM s r WHERE r.number <> 'R'),
h AS (SELECT page, above, count(*) AS n, min(y) AS top, max(y) AS bottom FROM g GROUP BY ALL)
SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY above) - 1 AS INTEGER) AS grp, n, top, bottom FROM h""")
def rule_groups(spark: SparkSession, d: str) -> DataFrame:
    lines = boxes(spark, d).select("page", F.col("y0").alias("y"), "number")
    return regions.rule_groups(lines.where("number <> 'R'"), lines.where("number = 'R'"))
