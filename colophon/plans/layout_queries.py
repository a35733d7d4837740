"""Queries on the lines of texts: figure and table text, page markers, caption spacing.

Some lines of the documents get labels and numbers in front, so that they look like
captions, labels and table rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colophon.functions import text as T
from colophon.operators import fonts, markers, scientific, tables, visuals
from colophon.plans.base import query, read

# --- figure and table text ---------------------------------------------------


def _words(n: str) -> str:
    return rf"regexp_extract(x, '^\S*(?:\s+\S+){{0,{n}}}')"


VISUAL = rf"""
vt AS (SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN (i - 1) % 9 = 4 THEN CASE (i - 1) % 2 WHEN 0 THEN 'Fig. ' ELSE '表 ' END || i || '. ' || x WHEN (i - 1) % 7 = 2 THEN {_words("2")} WHEN (i - 1) % 7 = 5 THEN '12.5 3.40 ' || {_words("1")}
  WHEN (i - 1) % 11 = 6 THEN 'noitnetta ' || {_words("1")} WHEN (i - 1) % 13 = 3 THEN (i - 1) || '. ' || {_words("3")} WHEN (i - 1) % 5 = 1 THEN {_words("5")} ELSE x END), chr(10)) || chr(10) AS text FROM documents)"""


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    def line(x, i):
        some = lambda n: F.regexp_extract(x, rf"^\S*(?:\s+\S+){{0,{n}}}", 0)
        label = F.when(i % 2 == 0, "Fig. ").otherwise("表 ")
        out = F.when(i % 9 == 4, F.concat(label, (i + 1).cast("string"), F.lit(". "), x)).when(i % 7 == 2, some(2)).when(i % 7 == 5, F.concat(F.lit("12.5 3.40 "), some(1)))
        return out.when(i % 11 == 6, F.concat(F.lit("noitnetta "), some(1))).when(i % 13 == 3, F.concat(i.cast("string"), F.lit(". "), some(3))).when(i % 5 == 1, some(5)).otherwise(x)

    text = F.concat(F.array_join(F.transform(F.split("text", "\n"), line), "\n"), F.lit("\n"))
    return read(spark, d, "documents").select("doc_id", text.alias("text"))


def _sql(pattern: str) -> str:
    return pattern.replace("'", "''")


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{visuals.SPACE}+|{visuals.SPACE}+$', '', 'g')"


def _strip_sql(guarded: bool) -> str:
    """Walks as range joins of captions, ends and markers with the lines they reach."""
    size = "length(t)" if guarded else r"length(t) + length(regexp_replace(t, '[^\x{10000}-\x{10FFFF}]', '', 'g'))"
    split = rf"string_split_regex(regexp_replace(text, '(?:{visuals.BREAKS})\z', ''), '{visuals.BREAKS}')" if guarded else r"string_split_regex(text, '\r?\n')"
    count = lambda p: f"len(regexp_extract_all(t, '{_sql(p)}'))"
    like = lambda c, p: f"regexp_matches({c}, '{_sql(p)}')"
    head = f"({like('t', visuals.HEADING)} OR {like('t', visuals.EQUATION)}"
    long = f"(size >= 60 AND ({count(visuals.HAN)} >= 8 OR {count(visuals.LATIN)} >= 8))"
    prose = f"(t <> '' AND {head} OR ({count(visuals.HAN)} >= 5 AND {like('t', '[，。；！？]$')}) OR ({count(visuals.LATIN)} >= 7 AND {like('t', '[.!?]$')}) OR {long}))"
    stop = f"(t <> '' AND NOT {like('t', visuals.SUB_LABEL)} AND {head} OR {like('t', visuals.BODY_START)} OR {long}))"
    signs = ", ".join(f"'{s}'" for s in visuals.SIGNS)
    metric = count(visuals.METRICS)
    row = rf"(t <> '' AND ({count(r'\d+\.\d+')} >= 2 OR (length(t) < 40 AND left(t, 1) IN ({signs})) OR ({metric} >= 2 AND {metric} * 2 > greatest(1, {count('[A-Za-z0-9]+')})) OR (length(t) <= 35 AND {like('t', r'[#×\d]')})))"
    up = "NOT prose AND t <> '' AND size <= 40 AND NOT contains(t, '=')" if guarded else "NOT prose"
    down = "NOT prose AND tbl" if guarded else "NOT prose"
    return rf"""WITH {VISUAL},
l0 AS (SELECT doc_id, unnest({split}) AS line, generate_subscripts({split}, 1) - 1 AS pos FROM vt WHERE text IS NOT NULL),
l1 AS (SELECT *, {_strip("line")} AS t FROM l0), l2 AS (SELECT *, {size} AS size FROM l1),
l3 AS (SELECT doc_id, pos, line, t, size, {prose} AS prose, {stop} AS stop, {row} AS tbl, {like("line", visuals.CAPTION)} AS cap, {like("t", "[.!?。！？]$")} AS term, {like("t", visuals.REVERSED)} AS rev FROM l2),
li AS (SELECT doc_id, pos, line, cap, term, rev, stop, {up} AS up, {down} AS down, max(pos) OVER (PARTITION BY doc_id) AS final FROM l3),
ce AS (SELECT doc_id, pos, coalesce((SELECT min(t.pos) FROM li t WHERE t.doc_id = c.doc_id AND t.pos >= c.pos AND t.term), final) AS fin, coalesce((SELECT max(u.pos) FROM li u WHERE u.doc_id = c.doc_id AND u.pos < c.pos AND NOT u.up), -1) AS roof FROM li c WHERE cap),
cf AS (SELECT *, coalesce((SELECT min(u.pos) FROM li u WHERE u.doc_id = ce.doc_id AND u.pos > ce.fin AND NOT u.down), 1000000000) AS floor FROM ce),
rm AS (SELECT doc_id, pos, lag(pos) OVER w AS p, lead(pos) OVER w AS n FROM li WHERE rev WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
rg AS (SELECT *, coalesce(pos - p <= {visuals.BETWEEN}, false) AS a, coalesce(n - pos <= {visuals.BETWEEN}, false) AS b FROM rm),
rf AS (SELECT doc_id, pos AS f, coalesce((SELECT max(u.pos) FROM li u WHERE u.doc_id = rg.doc_id AND u.pos < rg.pos AND u.stop), -1) AS roof FROM rg WHERE b AND NOT a),
rl AS (SELECT doc_id, pos AS l, coalesce((SELECT min(u.pos) FROM li u WHERE u.doc_id = rg.doc_id AND u.pos > rg.pos AND u.stop), 1000000000) AS floor FROM rg WHERE a AND NOT b),
gn AS (SELECT li.doc_id, li.pos FROM li JOIN cf ON cf.doc_id = li.doc_id AND (li.pos BETWEEN cf.pos AND cf.fin OR (li.pos < cf.pos AND li.pos > cf.roof AND cf.pos - li.pos <= {visuals.UP}) OR (li.pos > cf.fin AND li.pos < cf.floor AND li.pos - cf.fin <= {visuals.DOWN}))
  UNION SELECT li.doc_id, li.pos FROM li JOIN rg ON rg.doc_id = li.doc_id AND (li.pos = rg.pos AND (a OR b) OR (b AND li.pos BETWEEN rg.pos AND rg.n))
  UNION SELECT li.doc_id, li.pos FROM li JOIN rf ON rf.doc_id = li.doc_id AND li.pos < f AND li.pos > roof AND f - li.pos <= {visuals.UP}
  UNION SELECT li.doc_id, li.pos FROM li JOIN rl ON rl.doc_id = li.doc_id AND li.pos > l AND li.pos < floor AND li.pos - l <= {visuals.DOWN}),
kp AS (SELECT li.doc_id, count(gn.pos) AS gone, coalesce(string_agg(line, chr(10) ORDER BY li.pos) FILTER (gn.pos IS NULL), '') AS kept FROM li LEFT JOIN gn USING (doc_id, pos) GROUP BY 1)
SELECT doc_id, md5(CASE WHEN gone > 0 THEN {_strip("regexp_replace(kept, '\n{3,}', chr(10) || chr(10), 'g')")} ELSE text END) AS digest FROM vt LEFT JOIN kp USING (doc_id)"""


def _digests(spark: SparkSession, d: str, guarded: bool) -> DataFrame:
    out = visuals.strip_visuals(_labelled(spark, d), guarded=guarded)
    return out.select("doc_id", F.md5(F.col("stripped").cast("binary")).alias("digest"))


@query(_strip_sql(True))
def visual_strip(spark: SparkSession, d: str) -> DataFrame:
    return _digests(spark, d, True)


@query(_strip_sql(False))
def visual_strip_client(spark: SparkSession, d: str) -> DataFrame:
    return _digests(spark, d, False)


# --- page markers ------------------------------------------------------------



def _squeeze(c: str) -> str:
    return f"regexp_replace({c}, '{markers.SPACE}+', '', 'g')"



@query(f"""WITH RECURSIVE c AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE text IS NOT NULL),
t AS (SELECT conv_id, string_agg(replace(text, ' ', CASE WHEN turn % 2 = 0 THEN '  ' ELSE chr(10) || ' ' END), chr(10) || chr(10) ORDER BY turn) AS text FROM c GROUP BY 1),
s AS (SELECT conv_id, text, {_squeeze("text")} AS clean FROM t),
a AS (SELECT conv_id, turn + 1 AS page, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, anchor FROM (SELECT conv_id, turn, left({_squeeze("CASE WHEN turn % 5 = 3 THEN 'zz ' || text ELSE text END")}, 80) AS anchor FROM c) WHERE length(anchor) >= 10),
r AS (SELECT conv_id, 0 AS k, 0 AS fin, CAST(NULL AS BIGINT) AS place, CAST(NULL AS BIGINT) AS page FROM s
  UNION ALL SELECT r.conv_id, CAST(a.k AS INTEGER), CASE WHEN strpos(substring(clean, fin + 1), anchor) > 0 THEN CAST(fin + strpos(substring(clean, fin + 1), anchor) - 1 + length(anchor) AS INTEGER) ELSE fin END,
  CASE WHEN strpos(substring(clean, fin + 1), anchor) > 0 THEN fin + strpos(substring(clean, fin + 1), anchor) - 1 END, a.page FROM r JOIN a ON a.conv_id = r.conv_id AND a.k = r.k + 1 JOIN s ON s.conv_id = r.conv_id),
m AS (SELECT r.conv_id, r.page, r.place FROM r WHERE place IS NOT NULL),
ch AS (SELECT conv_id, unnest(string_split(text, '')) AS x, generate_subscripts(string_split(text, ''), 1) - 1 AS i FROM s),
cc AS (SELECT conv_id, i, x, CASE WHEN regexp_matches(x, '^{markers.SPACE}$') THEN NULL ELSE count(*) FILTER (NOT regexp_matches(x, '^{markers.SPACE}$')) OVER (PARTITION BY conv_id ORDER BY i) - 1 END AS place FROM ch),
o AS (SELECT cc.conv_id, string_agg(CASE WHEN m.page IS NULL THEN x ELSE '[Page ' || m.page || '] ' || x END, '' ORDER BY i) AS text, count(m.page) AS n_pages FROM cc LEFT JOIN m ON m.conv_id = cc.conv_id AND m.place = cc.place GROUP BY 1)
SELECT conv_id, n_pages, md5(text) AS digest FROM o""")
def page_markers(spark: SparkSession, d: str) -> DataFrame:
    """Turns are the pages of a conversation whose text has other white space; every fifth turn reads differently and is not found."""
    turns = read(spark, d, "conversations").where("text IS NOT NULL")
    wide = F.when(F.col("turn") % 2 == 0, F.replace("text", F.lit(" "), F.lit("  "))).otherwise(F.replace("text", F.lit(" "), F.lit("\n ")))
    texts = turns.groupBy(F.col("conv_id").alias("id")).agg(F.array_join(F.sort_array(F.collect_list(F.struct("turn", wide.alias("t"))))["t"], "\n\n").alias("text"))
    read_as = F.when(F.col("turn") % 5 == 3, F.concat(F.lit("zz "), "text")).otherwise(F.col("text"))
    pages = turns.select(F.col("conv_id").alias("id"), (F.col("turn") + 1).alias("page"), read_as.alias("text"))
    out = markers.with_page_markers(texts, pages)
    return out.select(F.col("id").alias("conv_id"), F.regexp_count("text", F.lit(r"\[Page [0-9]+\] ")).cast("long").alias("n_pages"), F.md5(F.col("text").cast("binary")).alias("digest"))


# --- captions ----------------------------------------------------------------


@query(r"""WITH c AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'Table' WHEN 1 THEN 'fig.' ELSE 'Figure' END || page_id || '.' || regexp_replace(url, '[/.:]', '', 'g') || page_id || CASE page_id % 4 WHEN 0 THEN 'K' WHEN 1 THEN 'kb.' ELSE 'data.Set' END AS t FROM pages),
a AS (SELECT page_id, regexp_replace(t, '(?i)\b(table|fig(?:ure)?\.?)([0-9]+)', '\1 \2', 'g') AS t FROM c),
b AS (SELECT page_id, regexp_replace(regexp_replace(t, '([A-Za-z])([0-9])', '\1 \2', 'g'), '([0-9])([A-Za-z]{1,2})([^A-Za-z0-9]|$)', '\1' || chr(1) || '\2\3', 'g') AS t FROM a),
e AS (SELECT page_id, replace(regexp_replace(t, '([0-9])([A-Za-z])', '\1 \2', 'g'), chr(1), '') AS t FROM b)
SELECT page_id, trim(regexp_replace(regexp_replace(t, '\.([A-Za-z])', '. \1', 'g'), '\s+', ' ', 'g')) AS caption FROM e""")
def caption_spacing(spark: SparkSession, d: str) -> DataFrame:
    page = F.col("page_id")
    front = F.when(page % 3 == 0, "Table").when(page % 3 == 1, "fig.").otherwise("Figure")
    back = F.when(page % 4 == 0, "K").when(page % 4 == 1, "kb.").otherwise("data.Set")
    text = F.concat(front, page.cast("string"), F.lit("."), F.regexp_replace("url", "[/.:]", ""), page.cast("string"), back)
    return read(spark, d, "pages").select("page_id", T.caption_spacing(text).alias("caption"))


# --- titles ------------------------------------------------------------------


@query(rf"""WITH s AS (SELECT doc_id AS page, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
p AS (SELECT page, CAST((length(line) * 7 + i * 5) % 23 AS DOUBLE) / 2 + 6 AS size, (i * 17 + page) % 3 * 150.0 AS x0, (i * 37 + page * 11) % 90 * 8.5 AS y0, regexp_replace(CASE WHEN (i + page) % 6 = 0 THEN left(line, 2) WHEN (i + page) % 7 = 1 THEN 'DOI ' || line ELSE left(line, 60) END, '^\s+|\s+$', '', 'g') AS text FROM s),
q AS (SELECT *, y0 < {0.45} * 800 AS upper FROM p WHERE text <> ''),
u AS (SELECT page, size, x0, y0, text, NOT regexp_matches(text, '(?i)arXiv|DOI|ISSN|ISBN|Contents lists|journal homepage|www\.|©|Copyright|Anonymous submission|^\d+$|^[IVXLC]+\s*$') AS good FROM q WHERE upper OR page NOT IN (SELECT page FROM q WHERE upper)),
l AS (SELECT a.page, a.size, count(*) AS n, max(length(b.text)) AS longest FROM (SELECT DISTINCT page, size FROM u) a JOIN u b ON b.page = a.page AND b.good AND b.size >= a.size - 0.6 GROUP BY ALL),
c AS (SELECT page, max(size) AS size FROM l WHERE n > 1 OR longest > 2 GROUP BY 1),
t AS (SELECT u.page, string_agg(text, ' ' ORDER BY round_even(y0 / 4, 0), x0, text) AS t FROM u JOIN c ON c.page = u.page AND u.good AND u.size >= c.size - 0.6 GROUP BY 1)
SELECT page, nullif(regexp_replace(regexp_replace(t, '\s+', ' ', 'g'), '^[ \t.:;,_-]+|[ \t.:;,_-]+$', '', 'g'), '') AS title FROM (SELECT DISTINCT page FROM p) LEFT JOIN t USING (page)""")
def font_titles(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a document are pieces of its first page, their length and place giving letters and position."""
    rows = read(spark, d, "documents").select(F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("i", "line"))
    i, page = F.col("i"), F.col("page")
    text = F.when((i + page) % 6 == 0, F.substring("line", 1, 2)).when((i + page) % 7 == 1, F.concat(F.lit("DOI "), "line")).otherwise(F.substring("line", 1, 60))
    size = ((F.length("line") * 7 + i * 5) % 23).cast("double") / 2 + 6
    pieces = rows.select("page", size.alias("size"), ((i * 17 + page) % 3 * 150.0).alias("x0"), ((i * 37 + page * 11) % 90 * 8.5).alias("y0"), text.alias("text"))
    return fonts.titles(pieces, 800.0)


# --- prose and formulas ------------------------------------------------------


def formula_texts(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose lines stand between delimiters, have indices and numbers, or stay as they are."""

    def line(x, i):
        first, rest = F.regexp_extract(x, r"^(\S*)", 1), F.regexp_extract(x, r"^\S*\s*(\S*)", 1)
        join = lambda *p: F.concat(*[F.lit(c) if isinstance(c, str) else c for c in p])
        m = i % 9
        out = F.when(m == 1, join("$", first, r"\$", rest, "$ ", x)).when(m == 2, join(r"\[", x, r" \quad (", (i % 7).cast("string"), r")\]")).when(m == 3, join(first, " = ", rest, " (", i.cast("string"), ")"))
        out = out.when(m == 4, join(first, "<sub>", rest, "</sub> &lt;sup&gt;2&lt;/sup&gt; ", x)).when(m == 5, join("$$", x, r"\tag{", i.cast("string"), "}$$")).when(m == 6, join(r"\(", first, r"\) open \[ ", x))
        return out.otherwise(x)

    return read(spark, d, "documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("text"))


@query()
def scientific_segments(spark: SparkSession, d: str) -> DataFrame:
    cut = formula_texts(spark, d).select("doc_id", F.posexplode(scientific.scientific_segments(F.col("text"))).alias("pos", "s"))
    return cut.select("doc_id", "pos", "s.*")


scientific_segments.texts = formula_texts


# --- tables ------------------------------------------------------------------

WORD_BOXES = r"""
ln AS (SELECT doc_id AS page, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
wl AS (SELECT page, i, list_filter(string_split_regex(line, '\s+'), lambda w: w <> '')[1:12] AS ws FROM ln),
w0 AS (SELECT page, i, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS j FROM wl),
w1 AS (SELECT page, i, j, CASE WHEN i % 12 = 0 AND j = 0 THEN 'Table ' || i || '.' WHEN i % 7 = 3 THEN length(w) || '.' || j WHEN i % 31 = 30 AND j = 0 THEN i || '. A' ELSE w END AS text FROM w0),
wb AS (SELECT page, i, j, text, 20.0 + coalesce(sum(length(text) * 5 + CASE WHEN i % 3 = 1 THEN 12 ELSE 3 END) OVER (PARTITION BY page, i ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS x0, i * 9.0 + j % 3 * 0.5 AS top FROM w1),
wd AS (SELECT page, i, j, text, x0, x0 + length(text) * 5 AS x1, top, top + 8 AS bottom FROM wb)"""


def word_lines(spark: SparkSession, d: str) -> DataFrame:
    """(page, i, words): the first words of each line of a document, clustered by document, since what follows works page by page."""
    rows = read(spark, d, "documents").select(F.col("doc_id").alias("page"), "text").repartition("page")
    rows = rows.select("page", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return rows.select("page", "i", F.slice(F.filter(F.split("line", r"\s+"), lambda w: w != ""), 1, 12).alias("words"))


def word_boxes(lines: DataFrame) -> DataFrame:
    """The words as boxes; some lines are captions, numbers, or spread out."""
    i, table, number = F.col("i"), F.col("i") % 12 == 0, F.col("i") % 7 == 3
    words = F.when(number, F.transform("words", lambda w, j: F.concat(F.length(w).cast("string"), F.lit("."), j.cast("string")))).otherwise(F.col("words"))
    first = F.when(table, F.concat(F.lit("Table "), i.cast("string"), F.lit("."))).when(~number & (i % 31 == 30), F.concat(i.cast("string"), F.lit(". A")))
    rows = lines.where(F.size("words") > 0).select("page", "i", words.alias("words"), first.alias("first"))
    rows = rows.withColumn("words", F.when(F.col("first").isNull(), F.col("words")).otherwise(F.concat(F.array("first"), F.slice("words", 2, 11))))
    rows, j = rows.select("page", "i", "words", F.posexplode("words").alias("j", "text")), F.col("j")
    x0 = 20.0 + F.length(F.array_join(F.slice("words", F.lit(1), j), "")) * 5 + j * F.when(i % 3 == 1, 12).otherwise(3)
    top = i * 9.0 + j % 3 * 0.5
    return rows.select("page", "i", "j", "text", x0.alias("x0"), (x0 + F.length("text") * 5).alias("x1"), top.alias("top"), (top + 8).alias("bottom"))


@query(rf"""WITH RECURSIVE {WORD_BOXES},
ba AS (SELECT page, CAST(i AS BIGINT) AS id, CASE i % 36 WHEN 0 THEN 'all' WHEN 12 THEN 'left' ELSE 'right' END AS side, top + 9 AS y0, top + 250 AS y1 FROM wd WHERE i % 12 = 0 AND j = 0),
sd AS (SELECT *, 'all' AS side FROM wd UNION ALL SELECT *, CASE WHEN x0 < 300 THEN 'left' ELSE 'right' END FROM wd),
tp AS (SELECT page, CAST(round_even(top / 4, 0) AS BIGINT) AS row, min(top) AS top FROM wd GROUP BY ALL),
gp AS (SELECT page, side, CAST(round_even(top / 4, 0) AS BIGINT) AS row, bottom, text, x0, x0 - lag(x1) OVER (PARTITION BY page, side, CAST(round_even(top / 4, 0) AS BIGINT) ORDER BY x0, x1, text) > 8 AS gap FROM sd),
rw AS (SELECT page, side, row, max(bottom) AS bottom, string_agg(text, '' ORDER BY x0, text) AS text, count(*) FILTER (gap) AS gaps FROM gp GROUP BY ALL),
rk AS (SELECT page, side, row, tp.top, bottom, text, gaps >= 2 OR len(regexp_extract_all(text, '\d')) > 0.3 * length(text) OR (length(text) < 45 AND (regexp_matches(text, '\[\d+\]') OR len(regexp_extract_all(text, '\d')) >= 3)) AS r,
  regexp_matches(text, '{tables.HEADING}') OR regexp_matches(text, '{tables.CAPTION}') AS title FROM rw JOIN tp USING (page, row)),
wk AS (SELECT ba.page, ba.id, rk.bottom, rk.r, title, length(text) >= 45 AND len(regexp_extract_all(text, '[\p{{L}}\p{{N}}]')) >= 20 AS prose, row_number() OVER (PARTITION BY ba.page, ba.id ORDER BY rk.row) AS n FROM ba JOIN rk ON rk.page = ba.page AND rk.side = ba.side AND rk.top >= y0 - 2 AND rk.top <= y1),
st AS (SELECT page, id, CAST(0 AS BIGINT) AS n, 0 AS neutral, CAST(NULL AS DOUBLE) AS body_bottom, CAST(0 AS BIGINT) AS n_rows FROM ba
  UNION ALL SELECT st.page, st.id, wk.n, CASE WHEN r THEN 0 ELSE neutral + 1 END, CASE WHEN r THEN CAST(wk.bottom AS DOUBLE) ELSE body_bottom END, n_rows + CAST(r AS BIGINT)
  FROM st JOIN wk ON wk.page = st.page AND wk.id = st.id AND wk.n = st.n + 1 WHERE NOT title AND (r OR (NOT prose AND neutral < 20)))
SELECT page, id, body_bottom, n_rows FROM st QUALIFY row_number() OVER (PARTITION BY page, id ORDER BY n DESC) = 1""")
def table_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Tables below every twelfth line, over the whole page or in one of its columns."""
    lines, i = word_lines(spark, d), F.col("i")
    side, top = F.when(i % 36 == 0, "all").when(i % 36 == 12, "left").otherwise("right"), i * 9.0
    bands = lines.where("i % 12 = 0 AND size(words) > 0").select("page", i.cast("long").alias("id"), side.alias("side"), (top + 9).alias("y0"), (top + 250).alias("y1"))
    return tables.table_bodies(bands, word_boxes(lines), 600.0)
