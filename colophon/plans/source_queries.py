"""Queries on bibliographic payloads, the search over several sources, and tasks that go on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colophon.functions import text as T
from colophon.operators import desk, federated, folds, fuzzy, index
from colophon.plans.base import query, read
from colophon.sources import works

# --- payloads ----------------------------------------------------------------

VENUES = "CASE p_partkey % 5 WHEN 0 THEN 'Proc. CVPR' WHEN 1 THEN 'Pattern Recognition' WHEN 2 THEN '' WHEN 3 THEN 'Journal of Rings' ELSE 'NeurIPS' END"
LEVELS = "CASE venue WHEN 'Proc. CVPR' THEN 'A' WHEN 'NeurIPS' THEN 'A' WHEN 'Pattern Recognition' THEN 'B' END"


def _venue() -> F.Column:
    k = F.col("p_partkey") % 5
    return F.when(k == 0, "Proc. CVPR").when(k == 1, "Pattern Recognition").when(k == 2, "").when(k == 3, "Journal of Rings").otherwise("NeurIPS")


@query(f"""WITH p AS (SELECT p_partkey, p_name AS title, p_brand, p_size, {VENUES} AS primary_venue, CASE WHEN p_partkey % 4 > 0 THEN '10.1/ab' || p_partkey END AS doi, p_partkey % 3 = 0 AS preprint FROM part),
v AS (SELECT *, CASE WHEN primary_venue <> '' THEN primary_venue WHEN p_partkey % 2 = 0 THEN 'Journal of Rings' ELSE '' END AS venue FROM p)
SELECT p_partkey, title, p_brand AS authors, venue, doi, CASE WHEN p_partkey % 6 = 0 THEN 'http://pdf/' || p_partkey END AS pdf_url, coalesce(CASE WHEN p_partkey % 6 = 0 THEN 'http://pdf/' || p_partkey END, 'https://doi.org/' || doi, '') AS page_url,
CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE p_size END AS citations, venue <> '' OR (doi IS NOT NULL AND NOT preprint) AS published, {LEVELS} AS level,
CASE p_partkey % 8 WHEN 0 THEN 'open' WHEN 1 THEN 'open' WHEN 2 THEN 'unknown' ELSE CASE WHEN venue IN ('Proc. CVPR', 'NeurIPS') OR p_partkey % 2 = 0 THEN 'open' ELSE 'closed' END END AS access, 'W' || p_partkey AS work_id FROM v""")
def work_rows(spark: SparkSession, d: str) -> DataFrame:
    k, s = F.col("p_partkey"), lambda c: c.cast("string")
    at = lambda name: F.struct(F.struct(name.alias("display_name")).alias("source"))
    m = k % 8
    access = F.struct(F.when(m == 0, True).when(m >= 3, False).alias("is_oa"), F.when(m == 1, "gold").when(m == 2, "odd").alias("oa_status"), F.when(k % 6 == 0, F.concat(F.lit(" http://pdf/"), s(k))).alias("oa_url"))
    payload = F.to_json(F.struct(
        F.concat(F.lit("https://x.org/W"), s(k)).alias("id"), F.concat(F.lit(" "), "p_name").alias("title"), F.when(k % 4 > 0, F.concat(F.lit("https://doi.org/10.1/ab"), s(k))).alias("doi"), F.when(k % 3 == 0, "preprint").alias("type"),
        F.lit(2020).alias("publication_year"), F.when(k % 7 > 0, F.col("p_size")).alias("cited_by_count"), F.array(F.struct(F.struct(F.col("p_brand").alias("display_name")).alias("author")), F.struct(F.struct(F.lit(" ").alias("display_name")).alias("author"))).alias("authorships"),
        at(_venue()).alias("primary_location"), F.when(k % 2 == 0, F.array(at(F.lit("arXiv (x)")), at(F.lit("Journal of Rings")))).alias("locations"), access.alias("open_access"),
    ))
    out = read(spark, d, "part").select("p_partkey", F.explode(F.array(works.work_row(payload))).alias("x")).where("x IS NOT NULL")
    return out.select("p_partkey", "x.title", F.array_join("x.authors", "|").alias("authors"), "x.venue", "x.doi", "x.pdf_url", "x.page_url", F.col("x.citations").cast("int").alias("citations"), "x.published", "x.level", "x.access", "x.work_id")


@query(f"""WITH p AS (SELECT p_partkey, p_name AS title, {VENUES} AS venue, p_size FROM part)
SELECT p_partkey, title, 1 AS n_authors, 2000 + p_size AS year, venue, CASE WHEN p_partkey % 2 = 0 THEN '10.2/' || p_partkey END AS doi, CASE WHEN p_partkey % 3 = 0 THEN 'http://f/' || p_partkey END AS pdf_url, p_size AS citations, {LEVELS} AS level FROM p""")
def search_hits(spark: SparkSession, d: str) -> DataFrame:
    """Answers of a JSON search interface, one good item and one that is no object in each."""
    k, s = F.col("p_partkey"), lambda c: c.cast("string")
    item = F.to_json(F.struct(F.concat("p_name", F.lit(" ")).alias("title"), (2000 + F.col("p_size")).alias("year"), _venue().alias("venue"), F.col("p_size").alias("citationCount"), F.array(F.struct(F.col("p_brand").alias("name")), F.struct(F.lit("").alias("name"))).alias("authors"), F.struct(F.when(k % 2 == 0, F.concat(F.lit("10.2/"), s(k))).alias("DOI")).alias("externalIds"), F.when(k % 3 == 0, F.struct(F.concat(F.lit("http://f/"), s(k)).alias("url"))).alias("openAccessPdf")))
    payload = F.concat(F.lit('{"total": 1, "data": ['), item, F.lit(", null]}"))
    out = read(spark, d, "part").select("p_partkey", F.explode(works.hit_rows(payload)).alias("x")).select("p_partkey", "x.*")
    return out.withColumn("citations", F.col("citations").cast("int"))


@query(f"""WITH p AS (SELECT p_partkey, p_name AS title, {VENUES} AS venue, p_size FROM part)
SELECT p_partkey, 0 AS pos, title, '2101.' || p_partkey AS key, 1970 + p_size AS year, 2 AS n_authors, venue, CASE WHEN p_partkey % 2 = 0 THEN '10.3/' || p_partkey END AS doi FROM p
UNION ALL SELECT p_partkey, 1, 'second', '', NULL, 0, '', NULL FROM p""")
def atom_entries(spark: SparkSession, d: str) -> DataFrame:
    k, s = F.col("p_partkey"), lambda c: c.cast("string")
    part = lambda *x: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in x])
    doi = F.when(k % 2 == 0, part("<arxiv:doi>10.3/", s(k), "</arxiv:doi>")).otherwise("")
    feed = part(
        "<feed><title>all</title><entry><id>http://a.org/abs/2101.", s(k), "v2</id>\n<title> ", F.replace("p_name", F.lit(" "), F.lit("\n")), "</title><published>", s(1970 + F.col("p_size")), "-01-02T00:00:00Z</published>",
        "<author><name> A </name></author><author><name>B</name></author><author><name> </name></author><arxiv:journal_ref>", _venue(), "</arxiv:journal_ref>", doi, "</entry><entry><id>x</id><title>second</title></entry></feed>",
    )
    return read(spark, d, "part").select("p_partkey", F.posexplode(works.atom_rows(feed)).alias("pos", "x")).select("p_partkey", "pos", "x.*")


# --- search over several sources ---------------------------------------------


@query("""WITH u AS (SELECT 0 AS src, s_suppkey AS i, s_suppkey % 40 AS q, 'name ' || (s_suppkey % 13) AS title, CAST(floor(s_acctbal) AS BIGINT) % 50 AS cites, s_suppkey % 3 = 0 AS arxiv FROM supplier
  UNION ALL SELECT 1, c_custkey, c_custkey % 40, 'Name  ' || (c_custkey % 13), CAST(floor(c_acctbal) AS BIGINT) % 50, c_custkey % 5 = 0 FROM customer),
n AS (SELECT n_nationkey AS i, n_name AS venue FROM nation),
e AS (SELECT u.*, CASE WHEN cites > 0 THEN cites ELSE 0 END AS citations, coalesce(CASE WHEN u.i % 2 = 0 THEN 'own' END, venue) AS venue, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS key FROM u LEFT JOIN n USING (i)),
f AS (SELECT *, row_number() OVER (PARTITION BY q, key ORDER BY citations > 0 DESC, arxiv DESC, src DESC, i DESC) AS best FROM e),
g AS (SELECT * FROM f WHERE best = 1)
SELECT q, i, src, citations, venue, CAST(row_number() OVER (PARTITION BY q ORDER BY venue IS NOT NULL DESC, citations DESC, src, i) AS INTEGER) AS place FROM g QUALIFY place <= 10""")
def federated_search(spark: SparkSession, d: str) -> DataFrame:
    """Sources united, venues filled in from a third, one row a title, the best first, the first page of each query.

    Of one title's rows a cited one stays, then one with a preprint, then the last.
    """
    one = lambda t, key, bal, front, m: read(spark, d, t).select(F.col(key).alias("i"), (F.col(key) % 40).alias("q"), F.concat(F.lit(front), (F.col(key) % 13).cast("string")).alias("title"), (F.floor(bal) % 50).alias("cites"), (F.col(key) % m == 0).alias("arxiv"))
    united = desk.in_source_order([one("supplier", "s_suppkey", "s_acctbal", "name ", 3), one("customer", "c_custkey", "c_acctbal", "Name  ", 5)], "i")
    rows = united.withColumn("citations", F.greatest(F.col("cites"), F.lit(0))).withColumn("venue", F.when(F.col("i") % 2 == 0, "own"))
    extra = read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("i"), F.col("n_name").alias("venue"))
    rows = federated.enrich(rows, extra, "i", ["venue"]).withColumn("key", T.title_norm(F.col("title")))
    last = W.partitionBy("q", "key").orderBy((F.col("citations") > 0).desc(), F.col("arxiv").desc(), F.col("source_pos").desc(), F.col("i").desc())
    rows = rows.withColumn("best", F.row_number().over(last)).where("best = 1")
    rows = rows.withColumns({"published": F.col("venue").isNotNull(), "level": F.lit(None).cast("string"), "position": F.struct("source_pos", "i")})
    placed = federated.priority_sort(rows, "q", "published", "level", "citations", "position").where("place <= 10")
    return placed.select("q", "i", F.col("source_pos").alias("src"), "citations", "venue", "place")


WINS = "(SELECT CASE WHEN f.citations > 0 AND r.citations <= 0 THEN TRUE WHEN r.citations > 0 AND f.citations <= 0 THEN FALSE WHEN f.arxiv AND NOT r.arxiv THEN TRUE ELSE FALSE END AS w)"


@query(f"""WITH RECURSIVE b AS (SELECT doc_id % 40 AS q, doc_id % 3 AS src, doc_id AS id, CASE WHEN doc_id % 4 > 0 THEN n_chars % 60 END AS work_id, lower(regexp_extract(text, '^(\\S*)')) AS title, n_chars % 5 AS citations, doc_id % 3 = 1 AS arxiv, row_number() OVER (PARTITION BY doc_id % 40, doc_id % 3 ORDER BY doc_id) AS pos FROM documents WHERE text IS NOT NULL),
bad AS (SELECT q, src FROM (SELECT DISTINCT q, src FROM b) WHERE (q + src) % 5 = 0 OR q % 13 = 5),
p AS (SELECT *, (pos - 1) // 2 + 1 AS w, row_number() OVER (PARTITION BY q, (pos - 1) // 2 ORDER BY src, pos) AS ord FROM b ANTI JOIN bad USING (q, src) WHERE pos <= 6),
r1 AS (SELECT *, row_number() OVER (PARTITION BY q, w, work_id ORDER BY ord) AS k, min(ord) OVER (PARTITION BY q, w, work_id) AS first_ord FROM p WHERE work_id IS NOT NULL),
f1 AS (SELECT q, w, work_id, id, citations, arxiv, title, k, first_ord FROM r1 WHERE k = 1 UNION ALL
  SELECT r.q, r.w, r.work_id, CASE WHEN x.w THEN f.id ELSE r.id END, CASE WHEN x.w THEN f.citations ELSE r.citations END, CASE WHEN x.w THEN f.arxiv ELSE r.arxiv END, CASE WHEN x.w THEN f.title ELSE r.title END, r.k, f.first_ord
  FROM f1 f JOIN r1 r ON r.q = f.q AND r.w = f.w AND r.work_id = f.work_id AND r.k = f.k + 1, LATERAL {WINS} x),
m AS (SELECT q, w, 0 AS part, first_ord AS ord, id, citations, arxiv, title FROM f1 QUALIFY row_number() OVER (PARTITION BY q, w, work_id ORDER BY k DESC) = 1 UNION ALL SELECT q, w, 1, ord, id, citations, arxiv, title FROM p WHERE work_id IS NULL),
r2 AS (SELECT *, row_number() OVER (PARTITION BY q, w, title ORDER BY part, ord) AS k, min(part * 1000000 + ord) OVER (PARTITION BY q, w, title) AS first_ord FROM m),
f2 AS (SELECT q, w, title, id, citations, arxiv, k, first_ord FROM r2 WHERE k = 1 UNION ALL
  SELECT r.q, r.w, r.title, CASE WHEN x.w THEN f.id ELSE r.id END, CASE WHEN x.w THEN f.citations ELSE r.citations END, CASE WHEN x.w THEN f.arxiv ELSE r.arxiv END, r.k, f.first_ord FROM f2 f JOIN r2 r ON r.q = f.q AND r.w = f.w AND r.title = f.title AND r.k = f.k + 1, LATERAL {WINS} x),
l AS (SELECT q, w, title, id, citations, row_number() OVER (PARTITION BY q, w ORDER BY citations DESC, first_ord) AS place FROM (SELECT * FROM f2 QUALIFY row_number() OVER (PARTITION BY q, w, title ORDER BY k DESC) = 1)),
k1 AS (SELECT q, title, id, citations, place, 1 AS since FROM l WHERE w = 1),
e2 AS (SELECT l.q, title, id, citations, coalesce(s, 0) + row_number() OVER (PARTITION BY l.q ORDER BY place) AS place, 2 AS since FROM l LEFT JOIN (SELECT q, max(place) AS s FROM k1 GROUP BY 1) n ON n.q = l.q WHERE w = 2 AND coalesce(s, 0) <= 3 AND NOT EXISTS (SELECT 1 FROM k1 WHERE k1.q = l.q AND k1.title = l.title)),
k2 AS (SELECT * FROM k1 UNION ALL SELECT * FROM e2),
e3 AS (SELECT l.q, title, id, citations, coalesce(s, 0) + row_number() OVER (PARTITION BY l.q ORDER BY place) AS place, 3 AS since FROM l LEFT JOIN (SELECT q, max(place) AS s FROM k2 GROUP BY 1) n ON n.q = l.q WHERE w = 3 AND coalesce(s, 0) <= 6 AND NOT EXISTS (SELECT 1 FROM k2 WHERE k2.q = l.q AND k2.title = l.title)),
pg AS (SELECT *, (place - 1) // 3 + 1 AS page FROM (SELECT * FROM k2 UNION ALL SELECT * FROM e3)),
t AS (SELECT q, max(n) AS total FROM (SELECT q, src, count(*) AS n FROM b ANTI JOIN bad USING (q, src) GROUP BY ALL) GROUP BY 1),
a AS (SELECT q, count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM bad WHERE bad.q = c.q AND bad.src = c.src)) AS lost FROM (SELECT DISTINCT q, src FROM b) c GROUP BY 1)
SELECT pg.q, CAST(page AS INTEGER) AS page, CAST(place AS INTEGER) AS place, id, citations, total, 'results' AS event FROM pg JOIN t ON t.q = pg.q WHERE page BETWEEN since AND 3
UNION ALL SELECT q, 1, 0, NULL, NULL, 0, 'error' FROM a WHERE lost = n""")
def federated_pages(spark: SparkSession, d: str) -> DataFrame:
    """Three pages of searches over three sources, some of which fail: a search all of whose sources fail is an error.

    Windows are two rows of each source, pages have three; ``total`` is the largest of the answering sources' totals.
    """
    k = F.col("doc_id")
    rows = read(spark, d, "documents").where("text IS NOT NULL").select(
        (k % 40).alias("query"), (k % 3).alias("source_pos"), k.alias("id"), F.when(k % 4 > 0, F.col("n_chars") % 60).alias("work_id"), F.lower(F.regexp_extract("text", r"^(\S*)", 1)).alias("title"),
        (F.col("n_chars") % 5).alias("citations"), (k % 3 == 1).alias("arxiv"),
    )
    rows = rows.withColumn("pos", F.row_number().over(W.partitionBy("query", "source_pos").orderBy("id"))).withColumn("window", F.ceil(F.col("pos") / 2).cast("int"))
    combos = rows.groupBy("query", "source_pos").agg(F.count("*").alias("n")).withColumn("failed", ((F.col("query") + F.col("source_pos")) % 5 == 0) | (F.col("query") % 13 == 5))
    failed = combos.where("failed").select("query", "source_pos")
    pages = federated.read_pages(federated.result_lists(rows.where("window <= 3"), failed), 3, 3)
    status = combos.groupBy("query").agg(F.max(F.when(~F.col("failed"), F.col("n"))).alias("total"), F.every("failed").alias("lost"))
    found = pages.join(status, "query").select(F.col("query").alias("q"), "page", "place", "id", "citations", "total", F.lit("results").alias("event"))
    none = F.lit(None).cast("long")
    lost = status.where("lost").select(F.col("query").alias("q"), F.lit(1).alias("page"), F.lit(0).alias("place"), none.alias("id"), none.alias("citations"), F.lit(0).cast("long").alias("total"), F.lit("error").alias("event"))
    return found.unionByName(lost)



@query(f"""WITH RECURSIVE p AS (SELECT p_partkey AS id, p_partkey AS pos, CASE WHEN p_partkey % 3 > 0 THEN p_size END AS work_id, lower(p_brand) AS title, p_partkey % 3 AS citations, p_type = 'SMALL' AS arxiv FROM part),
r1 AS (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY pos) AS k, min(pos) OVER (PARTITION BY work_id) AS first_pos FROM p WHERE work_id IS NOT NULL),
f1 AS (SELECT work_id, id, citations, arxiv, title, k, first_pos FROM r1 WHERE k = 1 UNION ALL
  SELECT r.work_id, CASE WHEN w THEN f.id ELSE r.id END, CASE WHEN w THEN f.citations ELSE r.citations END, CASE WHEN w THEN f.arxiv ELSE r.arxiv END, CASE WHEN w THEN f.title ELSE r.title END, r.k, f.first_pos
  FROM f1 f JOIN r1 r ON r.work_id = f.work_id AND r.k = f.k + 1, LATERAL {WINS}),
m AS (SELECT 0 AS part, first_pos AS pos, id, citations, arxiv, title FROM f1 QUALIFY row_number() OVER (PARTITION BY work_id ORDER BY k DESC) = 1 UNION ALL SELECT 1, pos, id, citations, arxiv, title FROM p WHERE work_id IS NULL),
r2 AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY part, pos) AS k FROM m),
f2 AS (SELECT title, id, citations, arxiv, k FROM r2 WHERE k = 1 UNION ALL
  SELECT r.title, CASE WHEN w THEN f.id ELSE r.id END, CASE WHEN w THEN f.citations ELSE r.citations END, CASE WHEN w THEN f.arxiv ELSE r.arxiv END, r.k FROM f2 f JOIN r2 r ON r.title = f.title AND r.k = f.k + 1, LATERAL {WINS})
SELECT title, max_by(id, k) AS id, max_by(citations, k) AS citations, CAST(max(k) AS INTEGER) AS n FROM f2 GROUP BY title""")
def two_pass_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """One row for each work by identifier, then one for each title; the richer row stays."""
    k = F.col("p_partkey")
    rows = read(spark, d, "part").select(k.alias("id"), k.alias("pos"), F.when(k % 3 > 0, F.col("p_size")).alias("work_id"), F.lower("p_brand").alias("title"), (k % 3).alias("citations"), (F.col("p_type") == "SMALL").alias("arxiv"))
    return federated.dedupe_twice(rows).drop("pos")


@query("""WITH a AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'routed/' || p_partkey END AS routed, CASE WHEN p_partkey % 2 = 0 THEN 'free/' || p_partkey END AS free FROM part)
SELECT p_partkey, coalesce(routed, free) AS link, CASE WHEN routed IS NOT NULL THEN 'routed' WHEN free IS NOT NULL THEN 'free' ELSE 'none' END AS tier FROM a""")
def free_links(spark: SparkSession, d: str) -> DataFrame:
    """The first tier of sources that knows a paper gives its link; none is no error."""
    parts = read(spark, d, "part").select("p_partkey")
    link = lambda name, m: parts.where(F.col("p_partkey") % m == 0).select("p_partkey", F.concat(F.lit(f"{name}/"), F.col("p_partkey").cast("string")).alias(name))
    out = parts.join(link("routed", 3), "p_partkey", "left").join(link("free", 2), "p_partkey", "left")
    return out.select("p_partkey", F.coalesce("routed", "free").alias("link"), F.when(F.col("routed").isNotNull(), "routed").when(F.col("free").isNotNull(), "free").otherwise("none").alias("tier"))


@query("""WITH k AS (SELECT DISTINCT l_partkey, l_suppkey, lower(regexp_replace('AX' || l_partkey || 'v' || (l_suppkey % 9), 'v[0-9]+$', '')) AS key FROM lineitem)
SELECT l_partkey, l_suppkey, p_name FROM k JOIN part ON key = 'ax' || p_partkey""")
def batch_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Rows found by identifier, whatever version it names: one join instead of requests of so many keys."""
    named = F.concat(F.lit("AX"), F.col("l_partkey").cast("string"), F.lit("v"), (F.col("l_suppkey") % 9).cast("string"))
    asked = read(spark, d, "lineitem").select("l_partkey", "l_suppkey", F.lower(F.regexp_replace(named, "v[0-9]+$", "")).alias("key")).distinct()
    found = read(spark, d, "part").select(F.lower(F.concat(F.lit("AX"), F.col("p_partkey").cast("string"))).alias("key"), "p_name")
    return asked.join(found, "key").select("l_partkey", "l_suppkey", "p_name")


@query()
def alike_titles(spark: SparkSession, d: str) -> DataFrame:
    """Every fortieth part's name against all names (with a letter changed in some)."""
    parts = read(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_name")
    asked = parts.where("id % 20 = 0").select("id", F.when(F.col("id") % 40 == 0, F.regexp_replace("p_name", "[aeiou]", "u")).otherwise(F.col("p_name")).alias("title"))
    return fuzzy.alike(asked, parts.withColumnRenamed("p_name", "title")).groupBy("target_id").agg(F.count("*").alias("n"), F.min("cand_id").alias("first"))


# --- tasks that go on --------------------------------------------------------


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, max(l_returnflag = 'R') AS failed, max(l_linestatus = 'F') AS done FROM lineitem GROUP BY ALL)
SELECT l_orderkey, l_linenumber FROM b WHERE failed OR NOT done""")
def blocks_to_resume(spark: SparkSession, d: str) -> DataFrame:
    """A translation goes on with the blocks that are not done or have failed."""
    rows = read(spark, d, "lineitem")
    blocks = rows.select("l_orderkey", "l_linenumber").distinct()
    kept = rows.groupBy("l_orderkey", "l_linenumber").agg(F.max(F.col("l_returnflag") == "R").alias("failed"), F.max(F.col("l_linestatus") == "F").alias("done")).where("done AND NOT failed")
    return blocks.join(kept, ["l_orderkey", "l_linenumber"], "left_anti")


TTL = 1800


@query(f"""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT user_id, k, t AS stored, false AS hit FROM e WHERE k = 1
  UNION ALL SELECT e.user_id, e.k, CASE WHEN e.t - stored <= {TTL} * 1000000 THEN stored ELSE e.t END, e.t - stored <= {TTL} * 1000000 FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
SELECT user_id, count(*) AS n, CAST(count(*) FILTER (hit) AS BIGINT) AS hits FROM r GROUP BY user_id""")
def cache_hits(spark: SparkSession, d: str) -> DataFrame:
    """Requests that find their key's result stored at most half an hour ago; others store it anew."""
    rows = read(spark, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))  # whole seconds would move the limit

    def step(state, row):
        hit = state is not None and row.t - state <= TTL * 1_000_000
        return (state if hit else row.t), hit

    out = folds.sorted_fold(rows, "user_id", ["t", "event_id"], step, "hit", "boolean")
    return out.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))


@query("""WITH o AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 2 = 0), n AS (SELECT CASE WHEN vec_id % 5 > 0 THEN vec_id - vec_id % 3 END AS vec_id, CASE WHEN vec_id % 7 > 0 THEN embedding END AS embedding, vec_id AS at FROM embeddings WHERE vec_id % 3 = 0)
SELECT vec_id, len(embedding) AS dim FROM o UNION ALL SELECT vec_id, len(embedding) FROM n WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND vec_id NOT IN (SELECT vec_id FROM o)""")
def index_rows(spark: SparkSession, d: str) -> DataFrame:
    """An index after an append: rows without key or vector are left out, known keys keep theirs."""
    e = read(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    new = e.where("vec_id % 3 = 0").select(F.when(F.col("vec_id") % 5 > 0, F.col("vec_id")).alias("vec_id"), F.when(F.col("vec_id") % 7 > 0, F.col("v")).alias("v"))
    return index.merged(e.where("vec_id % 2 = 0"), new, "vec_id").select("vec_id", F.size("v").cast("long").alias("dim"))


@query("""WITH q AS (SELECT item_id AS query_id, lower(text) AS text FROM benchmark)
SELECT query_id, CASE WHEN EXISTS (SELECT 1 FROM part WHERE contains(text, lower(p_type)) AND length(p_type) >= 3) THEN 'acronym' WHEN regexp_matches(text, 'blees|ention|outh') THEN 'term' WHEN length(text) % 2 = 0 THEN 'general' ELSE 'rag' END AS route FROM q""")
def question_routes(spark: SparkSession, d: str) -> DataFrame:
    """A title's acronym or a term of the field sends a question to the library; then an answer decides; the default is the library."""
    asked = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    hit = desk.acronym_mentions(asked, read(spark, d, "part").select(F.col("p_type").alias("title")).distinct()).select("query_id").distinct().withColumn("named", F.lit(True))
    low = F.lower("text")
    route = F.when(F.col("named"), "acronym").when(T.contains_any(low, ["blees", "ention", "outh"]), "term").when(F.length(low) % 2 == 0, "general").otherwise("rag")
    return asked.join(hit, "query_id", "left").select("query_id", route.alias("route"))


@query("""WITH t AS (SELECT DISTINCT l_orderkey, l_linenumber, l_linenumber % 3 AS level FROM lineitem),
e AS (SELECT *, (SELECT min(x.l_linenumber) FROM t x WHERE x.l_orderkey = t.l_orderkey AND x.l_linenumber > t.l_linenumber AND x.level <= t.level) AS stop FROM t),
s AS (SELECT l_orderkey, l_linenumber AS lo, coalesce(stop, 1000) AS hi FROM e WHERE level = 0)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem l WHERE EXISTS (SELECT 1 FROM s WHERE s.l_orderkey = l.l_orderkey AND l_linenumber >= lo AND l_linenumber < hi)""")
def chunks_of_subtrees(spark: SparkSession, d: str) -> DataFrame:
    """Chunks whose section lies in the subtree of a chosen heading (here: all of the top level)."""
    from colophon.operators import sections

    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    tree = sections.subtree_ends(rows.select("l_orderkey", "l_linenumber", (F.col("l_linenumber") % 3).alias("level")).distinct(), "l_orderkey", "l_linenumber", "level")
    chosen = tree.where("level = 0").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("lo"), F.coalesce("next_ordinal", F.lit(1000)).alias("hi"))
    return rows.join(chosen, (F.col("l_orderkey") == F.col("k")) & (F.col("l_linenumber") >= F.col("lo")) & (F.col("l_linenumber") < F.col("hi")), "left_semi")
