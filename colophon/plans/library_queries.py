"""Queries on libraries: filters, lookups, counts, orders, sets, per-paper search and jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colophon.functions import text as T
from colophon.operators import matching, retrieval
from colophon.plans.base import query, read
from colophon.streaming import jobs

# --- filters -----------------------------------------------------------------


@query("""SELECT p_partkey FROM part WHERE p_name ILIKE '%RING%' OR p_name ILIKE '%widget%'""")
def author_filter(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").where(F.col("p_name").ilike("%RING%") | F.col("p_name").ilike("%widget%")).select("p_partkey")


@query("""WITH s AS (SELECT CASE conv_id % 3 WHEN 0 THEN 'x_' ELSE 'sess_' END || substring(md5(CAST(conv_id AS VARCHAR)), 1, 8) AS s FROM conversations)
SELECT count(DISTINCT s) AS sessions, count(*) AS messages FROM s WHERE regexp_full_match(s, 'sess_[0-9a-f]{8}')""")
def session_pattern(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("conv_id")
    s = F.concat(F.when(i % 3 == 0, "x_").otherwise("sess_"), F.substring(F.md5(i.cast("string").cast("binary")), 1, 8))
    rows = read(spark, d, "conversations").select(s.alias("s")).where(F.col("s").rlike("^sess_[0-9a-f]{8}$"))
    return rows.agg(F.countDistinct("s").alias("sessions"), F.count("*").alias("messages"))


@query("""SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P' AND year(o_orderdate) BETWEEN 1995 AND 1997""")
def year_range(spark: SparkSession, d: str) -> DataFrame:
    y = F.when(F.col("o_orderstatus") != "P", F.year("o_orderdate"))  # a null year is outside any bound
    return read(spark, d, "orders").where(y.between(1995, 1997)).select("o_orderkey")


@query("""SELECT event_id FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-02'""")
def on_day(spark: SparkSession, d: str) -> DataFrame:
    ts = F.col("ts")  # a range on the column itself reaches the scan
    return read(spark, d, "events").where((ts >= F.lit("2024-01-02").cast("timestamp")) & (ts < F.lit("2024-01-03").cast("timestamp"))).select("event_id")


@query("""SELECT p_partkey FROM part WHERE p_size % 3 <> 0 OR (SELECT count(*) FROM part WHERE p_size % 3 <> 0) < 20""")
def drop_irrelevant(spark: SparkSession, d: str) -> DataFrame:
    part = read(spark, d, "part").withColumn("good", F.col("p_size") % 3 != 0)
    enough = part.agg((F.count_if("good") >= 20).alias("enough"))
    return part.join(F.broadcast(enough)).where(F.col("good") | ~F.col("enough")).select("p_partkey")  # one row


@query("""WITH h AS (SELECT conv_id, turn, contains(lower(text), 'ention') AS hit FROM conversations)
SELECT conv_id, turn FROM (SELECT *, bool_or(hit) OVER (PARTITION BY conv_id) AS found FROM h) WHERE hit OR NOT found""")
def evidence_keywords(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "conversations")
    return matching.keep_group_if_none(rows, "conv_id", F.contains(F.lower("text"), F.lit("ention"))).select("conv_id", "turn")


@query("""WITH s AS (SELECT conv_id, turn, contains(lower(text), 'ention') OR length(text) % 5 >= 3 AS hit FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 10)
SELECT conv_id, turn FROM (SELECT *, bool_or(hit) OVER (PARTITION BY conv_id) AS found FROM s) WHERE hit OR NOT found""")
def scored_or_keyword(spark: SparkSession, d: str) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("conv_id").orderBy("turn"))
    rows = read(spark, d, "conversations").withColumn("rank", rank).where("rank <= 10")
    hit = F.contains(F.lower("text"), F.lit("ention")) | (F.length("text") % 5 >= 3)
    return matching.keep_group_if_none(rows, "conv_id", hit).select("conv_id", "turn")


@query("""SELECT CASE WHEN doc_id IS NULL THEN 'id' WHEN length(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')) = 0 THEN 'empty' WHEN length(text) > 2000 THEN 'long' WHEN lang IS NULL OR lang NOT IN ('en', 'fr') THEN 'language' ELSE 'ok' END AS reason, count(*) AS n
FROM documents GROUP BY ALL""")
def reject_reasons(spark: SparkSession, d: str) -> DataFrame:
    blank = F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "") == ""
    known = F.coalesce(F.col("lang").isin("en", "fr"), F.lit(False))
    reason = F.when(F.col("doc_id").isNull(), "id").when(blank, "empty").when(F.length("text") > 2000, "long").when(~known, "language").otherwise("ok")
    return read(spark, d, "documents").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


# --- lookups -----------------------------------------------------------------


@query("""WITH f AS (SELECT p_partkey % 700 AS k, p_name AS title, p_size AS v FROM part)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce((SELECT min(v) FROM f WHERE k = l_partkey), (SELECT min(v) FROM f WHERE title = 'red widget')) AS v FROM lineitem""")
def lookup_with_fallback(spark: SparkSession, d: str) -> DataFrame:
    found = read(spark, d, "part").select((F.col("p_partkey") % 700).alias("k"), F.col("p_name").alias("title"), F.col("p_size").alias("v"))
    rows = read(spark, d, "lineitem").withColumn("k", F.col("l_partkey")).withColumn("title", F.lit("red widget"))
    return matching.lookup_with_fallback(rows, found, "k", "title", "v").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "v")


KBS = """b AS (SELECT label, list_transform(arg_min(embedding, vec_id), lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings GROUP BY label),
q AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE vec_id % 20 = 0)"""


@query(f"""WITH {KBS}, s AS (SELECT vec_id AS query_id, label, round(list_dot_product(q.e, b.e) / sqrt(list_dot_product(q.e, q.e)) / sqrt(list_dot_product(b.e, b.e)), 6) AS score FROM q, b)
SELECT query_id, CASE WHEN score > 0.3 THEN label END AS base, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label) = 1""")
def base_routing(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings")
    bases = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("v")).select(F.col("label").cast("long").alias("id"), "v")
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    best = retrieval.dense_topk(bases, asked, 1)
    return best.select("query_id", F.when(F.col("score") > 0.3, F.col("doc_id")).cast("int").alias("base"), "score")


@query("""WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
n AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e FROM u),
s AS (SELECT a.vec_id AS query_id, b.label AS paper, b.vec_id AS doc_id, round(list_dot_product(a.e, b.e), 6) AS score FROM n a JOIN n b ON a.vec_id % 20 = 0)
SELECT query_id, paper, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id, paper ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 3""")
def per_paper_topk(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.col("label").alias("paper"))
    return retrieval.per_paper_topk(e, e.where("id % 20 = 0").select("id", "v"), 3)


@query("""SELECT event_type, count(*) AS n, greatest(1, CAST(ceil(count(*) / 20.0) AS BIGINT)) AS max_page, 20 < count(*) AS more, least(max(CAST(json_extract(props, '$.k') AS BIGINT)) * 200, 10000) AS total,
CAST(count(*) FILTER (value < 5) AS BIGINT) AS failed, bool_and(value < 5) AS all_failed FROM events GROUP BY event_type""")
def page_math(spark: SparkSession, d: str) -> DataFrame:
    n, bad = F.count("*"), F.col("value") < 5
    total = F.least(F.max(F.get_json_object("props", "$.k").cast("long")) * 200, F.lit(10000).cast("long"))
    return read(spark, d, "events").groupBy("event_type").agg(
        n.alias("n"), F.greatest(F.lit(1), F.ceil(n / 20)).alias("max_page"), (n > 20).alias("more"), total.alias("total"), F.count_if(bad).alias("failed"), F.bool_and(bad).alias("all_failed")
    )


# --- counts ------------------------------------------------------------------


@query("""WITH c AS (SELECT l_orderkey, l_quantity, count(*) AS n, min(l_linenumber) AS first FROM lineitem GROUP BY ALL)
SELECT l_orderkey, arg_min(l_quantity, (-n, first, l_quantity)) AS body_size FROM c GROUP BY l_orderkey""")
def body_font_size(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "lineitem").groupBy("l_orderkey", "l_quantity").agg(F.count("*").alias("n"), F.min("l_linenumber").alias("first"))
    return c.groupBy("l_orderkey").agg(F.min_by("l_quantity", F.struct((-F.col("n")).alias("n"), "first", "l_quantity")).alias("body_size"))


@query("""SELECT o_custkey, bool_and(o_orderstatus = 'F') AS all_done, CAST(count(*) FILTER (o_orderstatus = 'O') AS BIGINT) AS open, count(*) FILTER (o_orderstatus = 'F') = 0 AND count(*) FILTER (o_orderstatus = 'P') > 0 AS notice,
min(o_totalprice) AS x0, max(o_totalprice) AS x1 FROM orders GROUP BY o_custkey""")
def task_counters(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("o_orderstatus")
    return read(spark, d, "orders").groupBy("o_custkey").agg(
        F.bool_and(s == "F").alias("all_done"), F.count_if(s == "O").alias("open"), ((F.count_if(s == "F") == 0) & (F.count_if(s == "P") > 0)).alias("notice"),
        F.min("o_totalprice").alias("x0"), F.max("o_totalprice").alias("x1"),
    )


@query("""SELECT l_returnflag AS section, count(*) AS n FROM lineitem GROUP BY l_returnflag""")
def section_counts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("section")).agg(F.count("*").alias("n"))


@query("""SELECT conv_id, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id""")
def joined_context(spark: SparkSession, d: str) -> DataFrame:
    piece = F.struct("turn", F.concat("role", F.lit(": "), "text").alias("piece"))
    rows = read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(piece)).alias("all"))  # one conversation
    return rows.select("conv_id", F.md5(F.array_join("all.piece", "\n").cast("binary")).alias("digest"))


# --- orders and sets ---------------------------------------------------------


@query("""SELECT p_brand, p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_type = 'SMALL' THEN 0 ELSE 1 END, (p_size % 2) * 0.5 + p_size / 100.0, p_partkey) AS INTEGER) AS place FROM part""")
def reading_order(spark: SparkSession, d: str) -> DataFrame:
    column = (F.col("p_size") % 2) * 0.5 + F.col("p_size") / 100.0
    w = W.partitionBy("p_brand").orderBy(F.col("p_type") != "SMALL", column, "p_partkey")
    return read(spark, d, "part").select("p_brand", "p_partkey", F.row_number().over(w).alias("place"))


@query("""SELECT p_name, arg_min(p_brand, p_partkey) AS p_brand, min(p_partkey) AS first FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_size > 45) GROUP BY p_name""")
def append_new_titles(spark: SparkSession, d: str) -> DataFrame:
    part = read(spark, d, "part")
    new = matching.append_new(part.where("p_size > 45"), part, "p_name", "p_partkey")
    return new.select("p_name", "p_brand", F.col("p_partkey").alias("first"))


@query("""SELECT user_id, event_type AS label, min(event_id) AS first_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY min(event_id)) AS INTEGER) AS place FROM events GROUP BY user_id, event_type""")
def ordered_labels(spark: SparkSession, d: str) -> DataFrame:
    seen = read(spark, d, "events").groupBy("user_id", F.col("event_type").alias("label")).agg(F.min("event_id").alias("first_id"))
    return seen.withColumn("place", F.row_number().over(W.partitionBy("user_id").orderBy("first_id")))


@query("""SELECT DISTINCT concat_ws('|', nullif(p_name, ''), nullif(p_brand, ''), nullif(CAST(p_size AS VARCHAR), '0')) AS key FROM part""")
def client_keys(spark: SparkSession, d: str) -> DataFrame:
    blank = lambda c, v: F.nullif(F.col(c).cast("string"), F.lit(v))
    return read(spark, d, "part").select(F.concat_ws("|", blank("p_name", ""), blank("p_brand", ""), blank("p_size", "0")).alias("key")).distinct()


@query("""SELECT p_name, arg_min(p_partkey, (-(length(p_type) - length(replace(p_type, 'A', ''))), -length(p_type), p_partkey)) AS keep, count(*) AS n FROM part GROUP BY p_name""")
def duplicate_figures(spark: SparkSession, d: str) -> DataFrame:
    marks = F.regexp_count("p_type", F.lit("A"))
    order = F.struct((-marks).alias("a"), (-F.length("p_type")).alias("b"), "p_partkey")
    return read(spark, d, "part").groupBy("p_name").agg(F.min_by("p_partkey", order).alias("keep"), F.count("*").alias("n"))


@query("""SELECT vec_id FROM embeddings WHERE label = 1 UNION SELECT doc_id FROM labels WHERE toxic = 1""")
def candidates_and_named(spark: SparkSession, d: str) -> DataFrame:
    a = read(spark, d, "embeddings").where("label = 1").select("vec_id")
    b = read(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("vec_id")).distinct()
    return a.unionByName(b.join(a, "vec_id", "left_anti"))


@query("""SELECT p_name FROM part WHERE p_size < 25 EXCEPT SELECT p_name FROM part WHERE p_size > 48""")
def title_difference(spark: SparkSession, d: str) -> DataFrame:
    part = read(spark, d, "part")
    return part.where("p_size < 25").select("p_name").subtract(part.where("p_size > 48").select("p_name"))


@query("""WITH q AS (SELECT conv_id, turn FROM conversations WHERE role = 'user')
SELECT conv_id, turn, s.source, CAST(s.pos AS INTEGER) AS pos FROM q, (SELECT unnest(['arxiv', 'openalex']) AS source, unnest([0, 1]) AS pos) s""")
def source_fan_out(spark: SparkSession, d: str) -> DataFrame:
    q = read(spark, d, "conversations").where("role = 'user'")
    return q.select("conv_id", "turn", F.posexplode(F.array(F.lit("arxiv"), F.lit("openalex"))).alias("pos", "source"))


# --- changes -----------------------------------------------------------------


@query(r"""SELECT doc_id, coalesce(CASE WHEN n_chars % 2 = 0 THEN 1999 END, list_max(list_transform(regexp_extract_all(text, '\b(20[0-9]{2})', 1), lambda y: CAST(y AS INTEGER)))) AS year FROM documents""")
def year_backfill(spark: SparkSession, d: str) -> DataFrame:
    old = F.when(F.col("n_chars") % 2 == 0, 1999)
    return read(spark, d, "documents").select("doc_id", F.coalesce(old, T.publication_year(F.col("text"))).alias("year"))


@query("""SELECT o_orderkey, 'order' AS what, count(*) AS n FROM orders WHERE o_custkey % 10 <> 0 GROUP BY ALL
UNION ALL SELECT l_orderkey, 'line', count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey % 10 <> 0) GROUP BY ALL""")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    kept = read(spark, d, "orders").where("o_custkey % 10 <> 0")
    children = read(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey").join(kept, "o_orderkey", "left_semi")
    count = lambda df, what: df.groupBy("o_orderkey").agg(F.count("*").alias("n")).select("o_orderkey", F.lit(what).alias("what"), "n")
    return count(kept, "order").unionByName(count(children, "line"))


@query("""SELECT doc_id, source, n_chars FROM documents WHERE source <> 'src1' UNION ALL SELECT doc_id, source, n_chars * 2 FROM documents WHERE source = 'src1' AND lang = 'en'""")
def rebuild_partition(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", "source", "n_chars", "lang")
    fresh = docs.where("source = 'src1' AND lang = 'en'").withColumn("n_chars", F.col("n_chars") * 2)
    return docs.where("source <> 'src1'").unionByName(fresh).drop("lang")


@query("""SELECT n, CAST(vocabulary AS BIGINT) AS vocabulary FROM (SELECT count(*) AS n FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)),
(SELECT count(DISTINCT w) AS vocabulary FROM (SELECT unnest(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS w FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)))""")
def index_delete(spark: SparkSession, d: str) -> DataFrame:
    kept = read(spark, d, "documents").join(read(spark, d, "labels").where("toxic = 1"), "doc_id", "left_anti")
    words = kept.select(F.explode(T.tokens(F.col("text"))).alias("w")).agg(F.countDistinct("w").alias("vocabulary"))
    return kept.agg(F.count("*").alias("n")).join(F.broadcast(words))  # one row each


# --- jobs --------------------------------------------------------------------

ACTIONS = "CASE event_type WHEN 'click' THEN 'advance' WHEN 'view' THEN 'advance' WHEN 'error' THEN 'fail' WHEN 'purchase' THEN 'retry' WHEN 'signup' THEN 'reset' END"


@query(f"""WITH RECURSIVE e AS (SELECT user_id AS job, {ACTIONS} AS a, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id) AS events FROM events),
f AS (SELECT job, CAST(0 AS BIGINT) AS i, 'pending' AS status, 0 AS progress, max(events) AS events FROM e GROUP BY job UNION ALL
  SELECT f.job, e.i, CASE WHEN status IN ('done', 'failed') THEN CASE WHEN a = 'retry' THEN 'pending' ELSE status END WHEN a = 'fail' THEN 'failed' WHEN a = 'reset' THEN 'pending'
    WHEN a = 'advance' THEN CASE status WHEN 'pending' THEN 'downloading' WHEN 'downloading' THEN 'parsing' ELSE 'done' END ELSE status END,
  CASE WHEN status IN ('done', 'failed') THEN CASE WHEN a = 'retry' THEN 0 ELSE progress END WHEN a = 'reset' THEN 0
    WHEN a = 'advance' THEN CASE status WHEN 'pending' THEN 10 WHEN 'downloading' THEN 50 ELSE 100 END ELSE progress END, f.events
  FROM f JOIN e ON e.job = f.job AND e.i = f.i + 1)
SELECT job, status, progress, events FROM f WHERE i = events""")
def job_states(spark: SparkSession, d: str) -> DataFrame:
    return jobs.job_states(job_events(read(spark, d, "events")))


def job_events(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), F.expr(ACTIONS).alias("action"))
