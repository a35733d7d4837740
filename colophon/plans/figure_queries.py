"""Queries on the regions of figures.

Order lines stand for boxes, eight orders being a page: lines numbered 1 are
captions, the others graphics or blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colophon.operators import figures, regions
from colophon.plans.base import query, read

WIDTH, HEIGHT = 720.0, 800.0

LAYOUT = """lay AS (SELECT l_orderkey // 8 AS page, ((l_partkey * 1000 + l_suppkey) * 10 + l_linenumber) * 8 + l_orderkey % 8 AS id, min(l_linenumber) AS kind, min(l_partkey) AS part, min(l_suppkey) AS supp,
  min(l_quantity) * 11 AS x0, CAST(min(floor(l_extendedprice)) AS BIGINT) % 700 + 0.5 AS y0, min(l_quantity) * 11 + 20 + min(l_partkey) % 150 AS x1, CAST(min(floor(l_extendedprice)) AS BIGINT) % 700 + 5.5 + min(l_suppkey) % 40 AS y1,
  CASE WHEN min(l_linenumber) = 1 THEN 'Figure ' || min(l_partkey) % 9 || '. Results of part ' || min(l_partkey) WHEN min(l_partkey) % 4 = 0 THEN 'fig. ' || min(l_suppkey) % 9 || ': on supplier ' || min(l_suppkey) WHEN min(l_partkey) % 4 = 1 THEN 'TABLE IV part' WHEN min(l_partkey) % 4 = 2 THEN 'GT' ELSE '' END AS caption FROM lineitem GROUP BY 1, 2)"""


def layout(spark: SparkSession, d: str) -> DataFrame:
    """(page, id, kind, part, supp, x0, y0, x1, y1, caption)."""
    lines = read(spark, d, "lineitem")
    page, order = F.floor(F.col("l_orderkey") / 8), F.col("l_orderkey") % 8
    lines = lines.withColumn("page", page).repartition("page")  # what follows works page by page
    rows = lines.groupBy("page", (((F.col("l_partkey") * 1000 + F.col("l_suppkey")) * 10 + F.col("l_linenumber")) * 8 + order).alias("id"))
    rows = rows.agg(F.min("l_linenumber").alias("kind"), F.min("l_partkey").alias("part"), F.min("l_suppkey").alias("supp"), (F.min("l_quantity") * 11).alias("x0"), (F.min(F.floor("l_extendedprice")) % 700 + 0.5).cast("double").alias("y0"))
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    part = F.col("part") % 4
    caption = F.when(F.col("kind") == 1, text("Figure ", F.col("part") % 9, ". Results of part ", F.col("part"))).when(part == 0, text("fig. ", F.col("supp") % 9, ": on supplier ", F.col("supp")))
    caption = caption.when(part == 1, "TABLE IV part").when(part == 2, "GT").otherwise("")
    return rows.withColumn("x1", F.col("x0") + 20 + F.col("part") % 150).withColumn("y1", F.col("y0") + 5 + F.col("supp") % 40).withColumn("caption", caption)


CAPS = """cap AS (SELECT page, id, x0, y0, x1, y1, caption, coalesce(lag(y1) OVER (PARTITION BY page ORDER BY y0, id), 0) AS up FROM lay WHERE kind = 1)"""


def page_captions(rows: DataFrame) -> DataFrame:
    """The captions, each with the lower edge of the one before it."""
    from pyspark.sql import Window as W

    caps = rows.where("kind = 1")
    return caps.withColumn("upper", F.coalesce(F.lag("y1").over(W.partitionBy("page").orderBy("y0", "id")), F.lit(0.0)))


@query(f"""WITH RECURSIVE {LAYOUT},{CAPS},
ab AS (SELECT c.page, c.id, c.y0 - 2 AS c, o.x0, o.y0, o.x1, o.y1, row_number() OVER (PARTITION BY c.page, c.id ORDER BY o.y1 DESC, o.y0, o.id) AS k FROM cap c JOIN lay o ON o.page = c.page AND o.kind <> 1 AND o.y0 < c.y0 - 2 AND o.y1 > 0 AND o.y1 > c.up),
r AS (SELECT page, id, 0 AS k, y0 - 2 AS top, y0 - 2 AS bottom, CAST(NULL AS DOUBLE) AS l, CAST(NULL AS DOUBLE) AS r FROM cap
  UNION ALL SELECT r.page, r.id, ab.k, least(r.top, ab.y0), greatest(r.bottom, ab.y1), least(coalesce(r.l, ab.x0), ab.x0), greatest(coalesce(r.r, ab.x1), ab.x1) FROM r JOIN ab ON ab.page = r.page AND ab.id = r.id AND ab.k = r.k + 1 WHERE r.top - ab.y1 <= 40),
e AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY page, id ORDER BY k DESC) = 1),
s AS (SELECT DISTINCT page, id, true AS sm FROM ab),
f AS (SELECT cap.*, e.k AS n, e.top, e.bottom, coalesce(s.sm, false) AS sm, coalesce(e.l, cap.x0 - CASE WHEN s.sm THEN 12 ELSE 0 END) AS l, coalesce(e.r, cap.x1 + CASE WHEN s.sm THEN 12 ELSE 0 END) AS rr FROM cap JOIN e USING (page, id) LEFT JOIN s USING (page, id)),
g AS (SELECT *, CASE WHEN up > top + 4 THEN top ELSE greatest(top, up) END AS t FROM f),
h AS (SELECT *, greatest(0, least(l, x0) - 12) AS a, least({WIDTH}, greatest(rr, x1) + 12) AS b FROM g)
SELECT page, id, CAST(n AS BIGINT) AS n, CASE WHEN x1 <= {WIDTH / 2 + 20} AND x0 < {WIDTH / 2} THEN a WHEN x0 >= {WIDTH / 2 - 20} AND x1 > {WIDTH / 2} THEN greatest(a, {WIDTH / 2 + 2}) ELSE a END AS x0,
  CAST(CASE WHEN NOT sm THEN greatest(up, y0 - {0.4 * HEIGHT}) WHEN bottom - t > {0.6 * HEIGHT} THEN bottom - {0.6 * HEIGHT} ELSE t END AS DOUBLE) AS y0,
  CASE WHEN x1 <= {WIDTH / 2 + 20} AND x0 < {WIDTH / 2} THEN least(b, {WIDTH / 2 - 2}) ELSE b END AS x1, CAST(CASE WHEN sm THEN bottom ELSE y0 - 2 END AS DOUBLE) AS y1 FROM h""")
def figure_regions(spark: SparkSession, d: str) -> DataFrame:
    rows = layout(spark, d)
    return figures.figure_regions(page_captions(rows).drop("caption"), rows.where("kind <> 1"), WIDTH, HEIGHT)


NUMBER = r"nullif(lower(regexp_extract({}, '(?i)^(fig(?:ure)?\.?|table)\s*(\d+[a-z]?|[IVXLCDM]+)', 2)), '')"


@query(f"""WITH {LAYOUT}, q AS (SELECT *, {NUMBER.format("caption")} AS num FROM lay)
SELECT c.page, c.id, c.caption FROM q c WHERE kind = 1 AND NOT EXISTS (SELECT 1 FROM q r WHERE r.page = c.page AND r.kind IN (2, 3) AND (r.num = c.num
  OR ((c.x0 + c.x1) / 2 BETWEEN r.x0 - 40 AND r.x1 + 40 AND (c.y0 + c.y1) / 2 BETWEEN r.y0 - 20 AND r.y1 + 20)))""")
def uncovered_captions(spark: SparkSession, d: str) -> DataFrame:
    """Captions that no block of the kinds 2 and 3 covers."""
    rows = layout(spark, d).drop("part", "supp")
    return figures.uncovered(rows.where("kind = 1"), rows.where("kind IN (2, 3)")).select("page", "id", "caption")


#: Components by recursion; ``pr`` holds neighbours, ``num`` their numbers.
NEAR = "((greatest(0, a.y0 - b.y1, b.y0 - a.y1) <= 40 AND least(a.x1, b.x1) - greatest(a.x0, b.x0) > 5) OR (greatest(0, a.x0 - b.x1, b.x0 - a.x1) <= 8 AND least(a.y1, b.y1) - greatest(a.y0, b.y0) > 5))"
JOINT = f"""
ne AS (SELECT a.page, a.id AS a, b.id AS b, a.num AS an, b.num AS bn, b.y0, b.x0 FROM fig a JOIN fig b ON a.page = b.page AND a.id <> b.id AND {NEAR}),
ur AS (SELECT page, id, id AS root FROM fig WHERE num IS NULL UNION SELECT ur.page, ne.b, ur.root FROM ur JOIN ne ON ne.page = ur.page AND ne.a = ur.id AND ne.an IS NULL AND ne.bn IS NULL),
ug AS (SELECT page, id, min(root) AS grp FROM ur GROUP BY ALL),
un AS (SELECT ug.page, ug.grp, ne.bn AS num FROM ug JOIN ne ON ne.page = ug.page AND ne.a = ug.id AND ne.bn IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ug.page, ug.grp ORDER BY ne.y0, ne.x0, ne.b) = 1),
nu AS (SELECT fig.page, fig.id, coalesce(fig.num, un.num) AS num FROM fig LEFT JOIN ug USING (page, id) LEFT JOIN un ON un.page = ug.page AND un.grp = ug.grp),
pr AS (SELECT ne.page, ne.a, ne.b FROM ne JOIN nu x ON x.page = ne.page AND x.id = ne.a JOIN nu y ON y.page = ne.page AND y.id = ne.b WHERE x.num IS NOT DISTINCT FROM y.num),
rc AS (SELECT page, id, id AS root FROM fig UNION SELECT rc.page, pr.b, rc.root FROM rc JOIN pr ON pr.page = rc.page AND pr.a = rc.id),
lb AS (SELECT page, id, min(root) AS region FROM rc GROUP BY ALL)"""


@query(f"""WITH RECURSIVE {LAYOUT}, fig AS (SELECT *, {NUMBER.format("caption")} AS num FROM lay WHERE kind > 3),{JOINT}
SELECT page, region, any_value(nu.num) AS number, count(*) AS n, min(x0) AS x0, CAST(min(y0) AS DOUBLE) AS y0, max(x1) AS x1, CAST(max(y1) AS DOUBLE) AS y1 FROM lb JOIN fig USING (page, id) JOIN nu USING (page, id) GROUP BY ALL""")
def numbered_regions(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours of one number become one region; those without a number take one from beside them."""
    rows = layout(spark, d).where("kind > 3").withColumn("number", figures.label_number(F.col("caption")))
    return regions.joint_regions(rows.drop("caption", "kind", "part", "supp"))


REGIONS = f"""
bl AS (SELECT page AS doc, part % 2 + 1 AS pg, id, CASE WHEN supp % 3 = 0 THEN 'table' ELSE 'figure' END AS kind, CASE WHEN regexp_matches(caption, '(?i)^(fig(?:ure)?\\.?|table)\\s*(\\d+[a-z]?|[IVXLCDM]+)') THEN caption ELSE '' END AS caption,
  x0 / 1000 * {WIDTH} AS x0, y0 / 1000 * {HEIGHT} AS y0, x1 / 1000 * {WIDTH} AS x1, y1 / 1000 * {HEIGHT} AS y1
  FROM lay WHERE kind <> 1 AND supp % 11 <> 0 AND part % 13 <> 0 AND (x1 - x0) / 1000 >= 0.001 AND (y1 - y0) / 1000 >= 0.001 AND (x1 - x0) / 1000 * ((y1 - y0) / 1000) >= 0.002),
fig AS (SELECT doc * 2 + pg AS page, doc, pg, id, caption, x0, y0, x1, y1, {NUMBER.format("caption")} AS num FROM bl WHERE kind = 'figure'),{JOINT},
ff AS (SELECT doc, pg, 'figure' AS kind, coalesce(arg_min(caption, row(NOT contains(caption, ' '), -length(caption), y0, x0, id)) FILTER (trim(caption) <> ''), '') AS caption, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, region FROM lb JOIN fig USING (page, id) GROUP BY doc, pg, region),
al AS (SELECT doc, pg, kind, caption, x0, y0, x1, y1, region FROM ff UNION ALL SELECT doc, pg, kind, caption, x0, y0, x1, y1, id FROM bl WHERE kind = 'table'),
ln AS (SELECT page AS doc, part % 2 + 1 AS pg, y0, id, caption AS text FROM lay WHERE kind = 1),
nb AS (SELECT al.doc, al.pg, al.kind, al.region, ln.text FROM al JOIN ln ON al.caption = '' AND ln.doc = al.doc AND ln.pg = al.pg QUALIFY row_number() OVER (PARTITION BY al.doc, al.pg, al.kind, al.region ORDER BY abs(ln.y0 - (al.y0 + al.y1) / 2), ln.y0, ln.id) = 1),
fi AS (SELECT al.*, coalesce(nb.text, al.caption) AS cap FROM al LEFT JOIN nb ON nb.doc = al.doc AND nb.pg = al.pg AND nb.kind = al.kind AND nb.region = al.region)
SELECT doc, CAST(pg AS INTEGER) AS pg, kind, cap AS caption, round(x0, 4) AS x0, round(y0, 4) AS y0, round(x1, 4) AS x1, round(y1, 4) AS y1 FROM fi WHERE kind = 'table' OR cap <> ''"""


@query(f"WITH RECURSIVE {LAYOUT},{REGIONS}")
def layout_regions(spark: SparkSession, d: str) -> DataFrame:
    """Layout replies in JSON, with broken entries among them, become figures and tables with captions."""
    rows = layout(spark, d)
    table = F.col("supp") % 3 == 0
    box = F.array("x0", "y0", "x1", "y1")
    # entries without a whole box or with no page, as models return them
    box = F.when(F.col("supp") % 11 == 0, F.slice(box, 1, 3)).otherwise(box)
    page = F.when(F.col("part") % 13 == 0, -1).otherwise(F.col("part") % 2).cast("int")
    captions = F.array(F.lit("(a)"), F.concat(F.lit(" "), "caption"))
    none = F.lit(None).cast("array<string>")
    entry = F.struct(
        F.when(table, "table").when(F.col("part") % 2 == 0, "image").otherwise("chart").alias("type"), box.alias("bbox"), page.alias("page_idx"),
        F.when(table, none).otherwise(captions).alias("image_caption"), F.when(table, captions).otherwise(none).alias("table_caption"), F.col("id").alias("img_path"),
    )
    replies = rows.where("kind <> 1").groupBy(F.col("page").alias("doc")).agg(F.to_json(F.sort_array(F.collect_list(F.struct("id", entry.alias("e"))))["e"]).alias("content"))
    lines = rows.where("kind = 1").select(F.struct(F.col("page").alias("doc"), (F.col("part") % 2 + 1).cast("int").alias("page")).alias("page"), "y0", F.col("id").alias("place"), F.col("caption").alias("text"))
    out = figures.layout_regions(replies, lines, WIDTH, HEIGHT)
    return out.select("page.doc", F.col("page.page").alias("pg"), "kind", "caption", *[F.round(c, 4).alias(c) for c in ("x0", "y0", "x1", "y1")])
