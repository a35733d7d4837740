"""Queries on listings, logs, orders and tasks of a library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colophon.operators import desk, matching, retrieval
from colophon.plans.base import query, read
from colophon.plans.paper_queries import TITLES, titles
from colophon.plans.registry import DENSE

# --- filters and orders ------------------------------------------------------

YEARS = "y AS (SELECT o_orderkey, CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(year(o_orderdate) AS INTEGER) END AS y FROM orders)"


@query(f"""WITH {YEARS} SELECT 'none' AS bounds, o_orderkey FROM y UNION ALL SELECT 'low', o_orderkey FROM y WHERE y >= 1997 UNION ALL SELECT 'both', o_orderkey FROM y WHERE y BETWEEN 1996 AND 1998""")
def year_bounds(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderpriority") != "5-LOW", F.year("o_orderdate")).alias("y"))
    parts = {"none": {}, "low": {"low": 1997}, "both": {"low": 1996, "high": 1998}}
    out = [desk.between_years(rows, "y", **b).select(F.lit(n).alias("bounds"), "o_orderkey") for n, b in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("""SELECT o_orderkey, CASE WHEN o_totalprice > 250000 OR o_orderstatus = 'F' THEN 'open' ELSE 'paywalled' END AS access FROM orders""")
def access_split(spark: SparkSession, d: str) -> DataFrame:
    """Open with a file's address or an open status, else behind a paywall."""
    rows = read(spark, d, "orders").select("o_orderkey", F.when(F.col("o_totalprice") > 250000, "https://x").alias("pdf_url"), F.when(F.col("o_orderstatus") == "F", "open").alias("status"))
    free = F.col("pdf_url").isNotNull() | F.coalesce(F.col("status") == "open", F.lit(False))
    return rows.select("o_orderkey", F.when(free, "open").otherwise("paywalled").alias("access"))


@query("SELECT conv_id, turn, md5(CAST(json_object('id', conv_id, 'role', role, 'content', text, 'turn', turn) AS VARCHAR)) AS digest FROM conversations")
def message_rows(spark: SparkSession, d: str) -> DataFrame:
    row = F.struct(F.col("conv_id").alias("id"), "role", F.col("text").alias("content"), "turn")
    return read(spark, d, "conversations").select("conv_id", "turn", F.md5(F.to_json(row, {"ignoreNullFields": "false"}).cast("binary")).alias("digest"))


@query(f"""WITH {TITLES} SELECT page_id FROM t JOIN pages USING (page_id) WHERE title <> '' AND contains(lower(url), 'example.net')""")
def notes_of_venue(spark: SparkSession, d: str) -> DataFrame:
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return read(spark, d, "pages").where((title != "") & F.contains(F.lower("url"), F.lit("example.net"))).select("page_id")


@query(f"""WITH {DENSE},
s AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round(list_dot_product(a.e, b.e), 6) AS score FROM n a JOIN n b ON a.vec_id % 20 = 0),
c AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 40)
SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM c WHERE doc_id % 3 = 1 QUALIFY rank <= 8""")
def section_hits(spark: SparkSession, d: str) -> DataFrame:
    """Candidates are fetched first; the section's filter comes after, and the first eight stay."""
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    found = retrieval.dense_topk(v, v.where(F.col("id") % 20 == 0), 40).where("doc_id % 3 = 1").drop("rank")
    return desk.first_of_each(found, "query_id", [F.col("score").desc(), F.col("doc_id")], 8)


@query(f"""WITH {DENSE},
s AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, list_dot_product(a.e, b.e) AS score FROM n a JOIN n b ON a.vec_id % 20 = 0),
c AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) <= 5)
SELECT query_id, doc_id, round(round(score, 6), 4) AS score, CASE label WHEN 0 THEN 'none' ELSE 'label ' || label END AS name FROM c JOIN embeddings ON vec_id = doc_id""")
def named_hits(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings")
    v = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    name = F.when(F.col("label") == 0, "none").otherwise(F.concat(F.lit("label "), F.col("label").cast("string")))
    found = retrieval.dense_topk(v, v.where(F.col("id") % 20 == 0), 5)
    return found.join(e.select(F.col("vec_id").alias("doc_id"), name.alias("name")), "doc_id").select("query_id", "doc_id", F.round("score", 4).alias("score"), "name")


@query("""WITH g AS (SELECT coalesce(nullif(lang, ''), 'unset') AS name, count(*) AS n FROM documents GROUP BY 1)
SELECT name, n, CAST(row_number() OVER (ORDER BY name = 'unset', name) AS INTEGER) AS place FROM g""")
def ordered_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups by name, the unset one last (a row a language)."""
    name = F.coalesce(F.nullif(F.col("lang"), F.lit("")), F.lit("unset"))
    groups = read(spark, d, "documents").groupBy(name.alias("name")).agg(F.count("*").alias("n"))
    return groups.withColumn("place", F.row_number().over(W.orderBy(F.col("name") == "unset", "name")))


@query("""SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS rank FROM events QUALIFY rank BETWEEN 11 AND 20""")
def page_slices(spark: SparkSession, d: str) -> DataFrame:
    return desk.page_slice(read(spark, d, "events").select("user_id", "event_id", "ts"), "user_id", [F.col("ts"), F.col("event_id")], 10, 10).select("user_id", "event_id", "rank")


@query("""SELECT event_type, event_id, CAST(row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS INTEGER) AS rank FROM events QUALIFY rank <= 3""")
def best_three(spark: SparkSession, d: str) -> DataFrame:
    return desk.first_of_each(read(spark, d, "events").select("event_type", "event_id", "value"), "event_type", [F.col("value").desc(), F.col("event_id")], 3).drop("value")


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag <> 'R', l_linenumber * 10000 + l_suppkey, l_partkey, l_extendedprice) AS INTEGER) AS place FROM lineitem""")
def block_order(spark: SparkSession, d: str) -> DataFrame:
    """Reading order: by page, figures before blocks, then by section and block number."""
    place = W.partitionBy("l_orderkey").orderBy("l_linenumber", F.col("l_returnflag") != "R", F.col("l_linenumber") * 10000 + F.col("l_suppkey"), "l_partkey", "l_extendedprice")
    return read(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.row_number().over(place).alias("place"))


@query("""SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority NOT LIKE '%URGENT', o_orderkey) AS INTEGER) AS place FROM orders""")
def accepted_first(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose label has the wanted ending first, otherwise in their own order."""
    place = W.partitionBy("o_custkey").orderBy(~F.endswith("o_orderpriority", F.lit("URGENT")), "o_orderkey")
    return read(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(place).alias("place"))


@query("""WITH l AS (SELECT l_orderkey, string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS lines FROM lineitem GROUP BY 1)
SELECT c_custkey, string_agg(o_orderkey || '[' || coalesce(lines, '') || ']', ' ' ORDER BY o_orderkey) AS orders, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN l ON l_orderkey = o_orderkey GROUP BY 1""")
def customer_details(spark: SparkSession, d: str) -> DataFrame:
    """A row with its children and their children, each list in its own order."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    text = lambda x: F.concat(x.l_linenumber.cast("string"), F.lit(":"), x.l_partkey.cast("string"))
    lines = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("x")).select("l_orderkey", F.array_join(F.transform("x", text), ",").alias("lines"))
    orders = read(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    one = F.concat(F.col("o_orderkey").cast("string"), F.lit("["), F.coalesce("lines", F.lit("")), F.lit("]"))
    orders = orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", one.alias("t")))).alias("x"))
    out = read(spark, d, "customer").join(orders, F.col("o_custkey") == F.col("c_custkey"), "left")
    return out.select("c_custkey", F.array_join(F.transform("x", lambda x: x.t), " ").alias("orders"), F.coalesce(F.size("x"), F.lit(0)).cast("long").alias("n"))


@query("""SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS INTEGER) AS newest FROM orders""")
def newest_first(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("o_custkey").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc())
    return read(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("newest"))


# --- sets, joins -------------------------------------------------------------


@query("""SELECT name, source_pos, CAST(row_number() OVER (PARTITION BY source_pos ORDER BY name) - 1 AS INTEGER) AS pos FROM (SELECT c_name AS name, 0 AS source_pos FROM customer UNION ALL SELECT s_name, 1 FROM supplier UNION ALL SELECT n_name, 2 FROM nation)""")
def source_union(spark: SparkSession, d: str) -> DataFrame:
    parts = [read(spark, d, t).select(F.col(c).alias("name")) for t, c in (("customer", "c_name"), ("supplier", "s_name"), ("nation", "n_name"))]
    return desk.in_source_order(parts, "name")


@query("""SELECT l_orderkey, coalesce(CASE WHEN l_linenumber % 3 > 0 THEN 'c' || l_linenumber END, l_returnflag) AS part, min(l_partkey) AS first_part FROM lineitem GROUP BY ALL""")
def unique_citations(spark: SparkSession, d: str) -> DataFrame:
    """One citation a paper and chunk (or section, where it has no chunk): the first."""
    part = F.coalesce(F.when(F.col("l_linenumber") % 3 > 0, F.concat(F.lit("c"), F.col("l_linenumber").cast("string"))), F.col("l_returnflag"))
    rows = read(spark, d, "lineitem").select("l_orderkey", part.alias("part"), "l_partkey")
    return desk.first_of_each(rows.withColumn("key", F.struct("l_orderkey", "part")), "key", [F.col("l_partkey")], 1).select("l_orderkey", "part", F.col("l_partkey").alias("first_part"))


@query("""WITH u AS (SELECT l_orderkey, min(l_linenumber) AS lo, max(l_linenumber) AS hi FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT l.l_orderkey, l_linenumber, l_partkey FROM lineitem l JOIN u ON u.l_orderkey = l.l_orderkey AND l_linenumber BETWEEN lo AND hi WHERE l_returnflag <> 'R'""")
def figures_in_units(spark: SparkSession, d: str) -> DataFrame:
    """Figures within the pages that a paper's translated units span."""
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    units = rows.where("l_returnflag = 'R'")
    return desk.within_windows(rows.where("l_returnflag <> 'R'"), units, "l_orderkey", "l_linenumber", "l_linenumber", "l_linenumber").drop("l_returnflag")


@query("""WITH c AS (SELECT l_orderkey % 50 AS conv_id, l_linenumber - 1 AS turn, l_partkey % 60 AS start_char, l_suppkey % 80 AS n, l_orderkey, l_linenumber, l_partkey FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, substring(text, start_char + 1, n) AS piece FROM c JOIN conversations USING (conv_id, turn)""")
def chunk_texts(spark: SparkSession, d: str) -> DataFrame:
    """The text of chunks that are stored as places on a page."""
    chunks = read(spark, d, "lineitem").select((F.col("l_orderkey") % 50).alias("conv_id"), (F.col("l_linenumber") - 1).cast("long").alias("turn"), (F.col("l_partkey") % 60 + 1).cast("int").alias("at"), (F.col("l_suppkey") % 80).cast("int").alias("n"), "l_orderkey", "l_linenumber", "l_partkey")
    pages = read(spark, d, "conversations").select("conv_id", "turn", "text")
    return chunks.join(pages, ["conv_id", "turn"]).select("l_orderkey", "l_linenumber", "l_partkey", F.substring(F.col("text"), F.col("at"), F.col("n")).alias("piece"))


KEYED = "e AS (SELECT p_partkey AS pos, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS title, p_brand AS href FROM part), t AS (SELECT s_suppkey AS target_id, CASE s_suppkey % 3 WHEN 0 THEN (SELECT title FROM e WHERE pos = s_suppkey) WHEN 1 THEN (SELECT string_split(title, ' ')[2] FROM e WHERE pos = s_suppkey) ELSE (SELECT 'the ' || title || ' x' FROM e WHERE pos = s_suppkey) END AS title FROM supplier)"


@query(f"""WITH {KEYED}, m AS (SELECT target_id, pos, href, CAST(e.title <> t.title AS INTEGER) AS pass FROM t JOIN e ON contains(e.title, t.title) OR contains(t.title, e.title) WHERE t.title <> '' AND e.title <> '')
SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY pass, pos) = 1""")
def title_pages(spark: SparkSession, d: str) -> DataFrame:
    key = F.trim(F.regexp_replace(F.lower("p_name"), "[^a-z0-9]+", " "))
    entries = read(spark, d, "part").select(F.col("p_partkey").alias("pos"), key.alias("title"), F.col("p_brand").alias("href"))
    named = read(spark, d, "supplier").select(F.col("s_suppkey").alias("target_id")).join(entries, F.col("target_id") == F.col("pos"))
    k = F.col("target_id") % 3
    want = F.when(k == 0, F.col("title")).when(k == 1, F.try_element_at(F.split("title", " "), F.lit(2))).otherwise(F.concat(F.lit("the "), "title", F.lit(" x")))
    return desk.two_pass_match(entries, named.select("target_id", want.alias("title")))


@query("""WITH w AS (SELECT DISTINCT lower(unnest(regexp_extract_all(c_mktsegment || ' ' || r_name, '[A-Z]{2,}'))) AS acronym FROM customer, region), q AS (SELECT p_partkey AS query_id, lower(p_name || p_type || p_brand) AS text FROM part)
SELECT query_id, acronym FROM q JOIN (SELECT acronym FROM w WHERE length(acronym) >= 3 UNION SELECT lower(p_type) FROM part WHERE length(p_type) >= 3) ON contains(text, acronym)""")
def acronym_mentions(spark: SparkSession, d: str) -> DataFrame:
    named = [read(spark, d, t).select(F.col(c).alias("title")).distinct() for t, c in (("customer", "c_mktsegment"), ("region", "r_name"), ("part", "p_type"))]
    asked = read(spark, d, "part").select(F.col("p_partkey").alias("query_id"), F.concat("p_name", "p_type", "p_brand").alias("text"))
    return desk.acronym_mentions(asked, named[0].unionByName(named[1]).unionByName(named[2]))


@query(r"""WITH p AS (SELECT conv_id, turn, '[Page ' || turn || ']' || chr(10) || coalesce(text, '') || chr(10) || '[Page ' || turn || ' end]' AS t FROM conversations)
SELECT conv_id, md5(regexp_replace(regexp_replace(string_agg(t, chr(10) || chr(10) ORDER BY turn), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')) AS digest FROM p GROUP BY conv_id""")
def marked_pages(spark: SparkSession, d: str) -> DataFrame:
    out = desk.marked_pages(read(spark, d, "conversations"), "conv_id", "turn", "text")
    return out.select("conv_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(f"""WITH {TITLES}, q AS (SELECT item_id AS query_id, lower(text) AS text FROM benchmark),
w AS (SELECT page_id, unnest(list_distinct(list_filter(list_transform(string_split(title, ' '), lambda x: lower(x)), lambda x: length(x) = 9 AND regexp_matches(x, '^[a-z]+$')))) AS word FROM t),
m AS (SELECT DISTINCT query_id, page_id FROM q JOIN w ON contains(text, word)),
s AS (SELECT query_id, page_id FROM q, (SELECT page_id FROM pages ORDER BY page_id DESC LIMIT 10) WHERE query_id NOT IN (SELECT query_id FROM m))
SELECT query_id, page_id, 5 AS k, true AS named FROM m UNION ALL SELECT query_id, page_id, 3, false FROM s""")
def named_or_sampled(spark: SparkSession, d: str) -> DataFrame:
    """Questions that name papers go to these alone, five chunks each; others sample the ten newest."""
    words = F.filter(F.transform(F.split("title", " "), F.lower), lambda x: (F.length(x) == 9) & x.rlike("^[a-z]+$"))
    named = titles(spark, d).select("page_id", F.explode(F.array_distinct(words)).alias("word"))
    asked = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.lower("text").alias("text"))
    held = asked.select("query_id", "text", F.explode(matching.grams(F.col("text"), 9)).alias("word")).join(named, "word").select("query_id", "page_id").distinct()
    newest = read(spark, d, "pages").select("page_id").orderBy(F.col("page_id").desc()).limit(10)
    rest = asked.join(held, "query_id", "left_anti").select("query_id").join(F.broadcast(newest))  # ten rows
    return held.select("query_id", "page_id", F.lit(5).alias("k"), F.lit(True).alias("named")).unionByName(rest.select("query_id", "page_id", F.lit(3).alias("k"), F.lit(False).alias("named")))


@query(f"""WITH {DENSE},
s AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round(list_dot_product(a.e, b.e), 6) AS score FROM n a JOIN n b ON a.vec_id % 20 = 0),
c AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= CASE WHEN query_id % 40 = 0 THEN 20 ELSE 8 END),
l AS (SELECT c.query_id, c.doc_id FROM c JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = doc_id WHERE a.label = b.label AND query_id <> doc_id AND score >= 0.4),
f AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % 20 = 0 AND a.vec_id NOT IN (SELECT query_id FROM l))
SELECT query_id, doc_id, false AS fallback FROM l UNION ALL SELECT query_id, doc_id, true FROM f""")
def task_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Reviews read twenty chunks, other tasks eight; a task without any result reads all chunks of its paper."""
    e = read(spark, d, "embeddings")
    v = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    label = lambda c, n: e.select(F.col("vec_id").alias(c), F.col("label").alias(n))
    found = retrieval.dense_topk(v, v.where(F.col("id") % 20 == 0), 20).where(F.col("rank") <= F.when(F.col("query_id") % 40 == 0, 20).otherwise(8))
    own = found.where("score >= 0.4 AND query_id <> doc_id").join(label("query_id", "a"), "query_id").join(label("doc_id", "b"), "doc_id").where("a = b").select("query_id", "doc_id")
    empty = label("query_id", "a").where(F.col("query_id") % 20 == 0).join(own, "query_id", "left_anti")
    rest = empty.join(label("doc_id", "b"), F.col("a") == F.col("b")).select("query_id", "doc_id")
    return own.withColumn("fallback", F.lit(False)).unionByName(rest.withColumn("fallback", F.lit(True)))


@query("SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN s_name || ': ' || n_name ELSE s_name END AS text FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def base_texts(spark: SparkSession, d: str) -> DataFrame:
    """What a library's description vector is made from: name and description, or the name alone."""
    rows = read(spark, d, "supplier").join(read(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    return rows.select("s_suppkey", F.concat_ws(": ", "s_name", F.when(F.col("s_acctbal") > 0, F.col("n_name"))).alias("text"))


# --- logs and changes --------------------------------------------------------


@query("""WITH a AS (SELECT conv_id, turn, text FROM conversations WHERE conv_id % 7 <> 0 UNION ALL SELECT user_id, 1000 + event_id, event_type FROM events WHERE user_id % 7 <> 0)
SELECT conv_id, count(*) AS n, max_by(md5(text), turn) AS last FROM a GROUP BY conv_id""")
def message_log(spark: SparkSession, d: str) -> DataFrame:
    """Messages appended to the sessions' log, some sessions cleared, the rest loaded."""
    log = read(spark, d, "conversations").select("conv_id", "turn", "text")
    new = read(spark, d, "events").select(F.col("user_id").alias("conv_id"), (1000 + F.col("event_id")).alias("turn"), F.col("event_type").alias("text"))
    whole = log.unionByName(new)
    cleared = whole.select("conv_id").distinct().where("conv_id % 7 = 0")
    left = whole.join(cleared, "conv_id", "left_anti")
    return left.groupBy("conv_id").agg(F.count("*").alias("n"), F.max_by(F.md5(F.col("text").cast("binary")), "turn").alias("last"))


@query("""WITH p AS (SELECT l_orderkey, max(l_returnflag = 'R' AND l_linestatus = 'F') AS failed FROM lineitem GROUP BY 1)
SELECT o_orderkey, CASE WHEN failed THEN 'failed' ELSE 'pending' END AS status, 0 AS progress FROM orders LEFT JOIN p ON l_orderkey = o_orderkey""")
def import_rows(spark: SparkSession, d: str) -> DataFrame:
    """New imports are pending; one whose paper has failed has failed too."""
    papers = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")).alias("failed"))
    rows = read(spark, d, "orders").join(papers, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return rows.select("o_orderkey", F.when(F.coalesce("failed", F.lit(False)), "failed").otherwise("pending").alias("status"), F.lit(0).alias("progress"))


STEPS = {"view": "parsing", "click": "indexing", "purchase": "reporting", "error": "failed"}


@query(f"""WITH s AS (SELECT user_id, ts, event_id, CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STEPS.items())} ELSE 'ready' END AS status FROM events),
l AS (SELECT *, lag(status) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM s)
SELECT user_id, max_by(status, (ts, event_id)) AS status, count(*) FILTER (status <> coalesce(before, 'uploaded')) AS changes, count(*) FILTER (status = 'failed' AND coalesce(before, 'uploaded') <> 'failed') AS failures FROM l GROUP BY user_id""")
def task_states(spark: SparkSession, d: str) -> DataFrame:
    """A paper's state is that of its last event; it starts as uploaded, and each real change counts."""
    status = F.lit("ready")
    for k, v in STEPS.items():
        status = F.when(F.col("event_type") == k, v).otherwise(status)
    rows = read(spark, d, "events").select("user_id", "ts", "event_id", status.alias("status"))
    before = F.coalesce(F.lag("status").over(W.partitionBy("user_id").orderBy("ts", "event_id")), F.lit("uploaded"))
    rows = rows.withColumn("before", before)
    return rows.groupBy("user_id").agg(
        F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.count_if(F.col("status") != F.col("before")).alias("changes"), F.count_if((F.col("status") == "failed") & (F.col("before") != "failed")).alias("failures")
    )


@query("""WITH l AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type <> 'error') AS good, max(user_id % 4 = 0) AS direct FROM events GROUP BY 1)
SELECT event_id FROM events JOIN l USING (user_id) WHERE event_type <> 'error' OR n > 60 OR good < 20 OR direct""")
def relevant_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "events").select("event_id", "user_id", "event_type")
    return desk.without_irrelevant(rows, "user_id", F.col("event_type") == "error", F.col("user_id") % 4 == 0).select("event_id")


@query("""WITH q AS (SELECT conv_id, list_distinct(regexp_extract_all(lower(arg_min(text, turn)), '([a-z]{8,})', 1)) AS terms FROM conversations GROUP BY 1),
h AS (SELECT conv_id, turn, len(list_filter(terms, lambda x: contains(lower(text), x))) > 0 AS hit FROM conversations JOIN q USING (conv_id) WHERE turn > 0)
SELECT conv_id, turn FROM h QUALIFY hit OR NOT coalesce(bool_or(hit) OVER (PARTITION BY conv_id), false)""")
def question_terms(spark: SparkSession, d: str) -> DataFrame:
    """Later messages that hold a long word of the first; all of a session where none does."""
    rows = read(spark, d, "conversations")
    asked = rows.groupBy("conv_id").agg(F.min_by("text", "turn").alias("question"))
    return desk.with_question_terms(rows.where("turn > 0"), asked, "conv_id", "[a-z]{8,}").select("conv_id", "turn")
