"""All queries over the given tables, by name, with their SQL.

Where a search needs queries, they are the rows whose id is divisible by 20, or
all benchmark passages, against all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colophon.functions import papers as P
from colophon.functions import text as T
from colophon.operators import chunking, federated, library, retrieval, sections
from colophon.plans.base import ORACLE_SQL, QUERIES, query, read  # noqa: F401
from colophon.sources import files, html
from colophon.streaming import progress

# --- retrieval ---------------------------------------------------------------

DENSE = """
u AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
n AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e FROM u)"""
TOKENS = r"list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')"
BM25 = f"""
w AS (SELECT doc_id, {TOKENS} AS w FROM documents),
l AS (SELECT doc_id, len(w) AS len FROM w),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM w) GROUP BY ALL),
s AS (SELECT count(*) AS n, avg(len) AS avgdl FROM l),
r AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw, avgdl FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), s),
i AS (SELECT term, avgdl, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM r) ELSE raw END AS idf FROM r),
q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({TOKENS}) AS term FROM benchmark) GROUP BY ALL),
h AS (SELECT query_id, doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))) AS score
      FROM q JOIN i USING (term) JOIN tf USING (term) JOIN l USING (doc_id) GROUP BY ALL),
b AS (SELECT item_id AS query_id, l.doc_id, round(coalesce(score, 0), 6) AS score
      FROM (SELECT item_id FROM benchmark) a CROSS JOIN l LEFT JOIN h ON h.query_id = item_id AND h.doc_id = l.doc_id)"""


def hybrid_sql(fetch: int, where: str = "TRUE") -> str:
    """Both lists of ``fetch`` rows, normalised, fused and filtered."""
    spread = "CASE WHEN max(score) OVER (PARTITION BY query_id) = min(score) OVER (PARTITION BY query_id) THEN 1 ELSE (score - min(score) OVER (PARTITION BY query_id)) / (max(score) OVER (PARTITION BY query_id) - min(score) OVER (PARTITION BY query_id)) END"
    return f"""WITH {DENSE},{BM25},
d AS (SELECT a.vec_id AS query_id, x.vec_id AS doc_id, round(list_dot_product(a.e, x.e), 6) AS score FROM n a JOIN n x ON a.vec_id IN (SELECT item_id FROM benchmark)),
dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rv FROM d QUALIFY rv <= {fetch}),
br AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rk FROM b QUALIFY rk <= {fetch}),
dn AS (SELECT query_id, doc_id, rv, {spread} AS nv FROM dr),
bn AS (SELECT query_id, doc_id, rk, {spread} AS nk FROM br),
f AS (SELECT coalesce(dn.query_id, bn.query_id) AS query_id, coalesce(dn.doc_id, bn.doc_id) AS doc_id, rv, rk, nv, nk
      FROM dn FULL JOIN bn ON dn.query_id = bn.query_id AND dn.doc_id = bn.doc_id),
g AS (SELECT *, round(CASE WHEN max(nv) OVER (PARTITION BY query_id) IS NULL THEN nk ELSE 0.7 * coalesce(nv, 0) + 0.3 * coalesce(nk, 0) END, 6) AS score FROM f)
SELECT query_id, doc_id, round(score, 3) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY g.score DESC, rv NULLS LAST, rk NULLS LAST, doc_id) AS INTEGER) AS rank
FROM g WHERE {where} QUALIFY rank <= 5"""


@query(f"""WITH {DENSE},
s AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round(list_dot_product(a.e, b.e), 6) AS score FROM n a JOIN n b ON a.vec_id % 20 = 0)
SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
FROM s QUALIFY rank <= 5""")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return retrieval.dense_topk(v, v.where(F.col("id") % 20 == 0), 5)


@query(f"""WITH {BM25}
SELECT query_id, doc_id, round(score, 3) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
FROM b QUALIFY rank <= 5""")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    asked = read(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    return retrieval.bm25_topk(docs, asked, 5).withColumn("score", F.round("score", 3))


def _hybrid(spark: SparkSession, d: str, base: DataFrame | None = None) -> DataFrame:
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    asked = read(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    return retrieval.hybrid_topk(docs, v, asked, v.join(asked.select("id"), "id", "left_semi"), 5, base).withColumn("score", F.round("score", 3))


@query(hybrid_sql(10))
def hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d)


@query(hybrid_sql(20, "doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')"))
def hybrid_in_base(spark: SparkSession, d: str) -> DataFrame:
    """One language's documents are the base: the filter comes after fusion."""
    return _hybrid(spark, d, read(spark, d, "documents").where("lang = 'en'").select("doc_id"))


def paper_sql(k: int, where: str = "TRUE") -> str:
    """Both lists within each paper, fused, filtered and cut."""
    spread = "CASE WHEN max(score) OVER v = min(score) OVER v THEN 1 ELSE (score - min(score) OVER v) / (max(score) OVER v - min(score) OVER v) END"
    return f"""WITH {DENSE},
ch AS (SELECT vec_id AS doc_id, label AS paper, lang AS section, text, n.e FROM embeddings JOIN n USING (vec_id) JOIN documents ON documents.doc_id = vec_id),
w AS (SELECT paper, doc_id, {TOKENS} AS w FROM ch), l AS (SELECT paper, doc_id, len(w) AS len FROM w),
tf AS (SELECT paper, doc_id, term, count(*) AS tf FROM (SELECT paper, doc_id, unnest(w) AS term FROM w) GROUP BY ALL),
s AS (SELECT paper, count(*) AS n, avg(len) AS avgdl FROM l GROUP BY 1),
r AS (SELECT paper, term, ln(n - df + 0.5) - ln(df + 0.5) AS raw, avgdl FROM (SELECT paper, term, count(*) AS df FROM tf GROUP BY ALL) JOIN s USING (paper)),
i AS (SELECT paper, term, avgdl, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER (PARTITION BY paper) ELSE raw END AS idf FROM r),
q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({TOKENS}) AS term FROM benchmark) GROUP BY ALL),
h AS (SELECT query_id, paper, doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))) AS score FROM q JOIN i USING (term) JOIN tf USING (paper, term) JOIN l USING (paper, doc_id) GROUP BY ALL),
b AS (SELECT item_id AS query_id, l.paper, l.doc_id, round(coalesce(score, 0), 6) AS score FROM (SELECT item_id FROM benchmark) a CROSS JOIN l LEFT JOIN h ON h.query_id = item_id AND h.doc_id = l.doc_id AND h.paper = l.paper),
d AS (SELECT item_id AS query_id, ch.paper, ch.doc_id, round(list_dot_product(n.e, ch.e), 6) AS score FROM benchmark JOIN n ON n.vec_id = item_id CROSS JOIN ch),
dr AS (SELECT *, row_number() OVER (PARTITION BY query_id, paper ORDER BY score DESC, doc_id) AS rv FROM d QUALIFY rv <= {8 * k}),
br AS (SELECT *, row_number() OVER (PARTITION BY query_id, paper ORDER BY score DESC, doc_id) AS rk FROM b QUALIFY rk <= {8 * k}),
dn AS (SELECT query_id, paper, doc_id, rv, {spread} AS nv FROM dr WINDOW v AS (PARTITION BY query_id, paper)),
bn AS (SELECT query_id, paper, doc_id, rk, {spread} AS nk FROM br WINDOW v AS (PARTITION BY query_id, paper)),
f AS (SELECT query_id, paper, doc_id, rv, rk, nv, nk FROM dn FULL JOIN bn USING (query_id, paper, doc_id)),
g AS (SELECT *, round(CASE WHEN max(nv) OVER (PARTITION BY query_id, paper) IS NULL THEN nk ELSE 0.7 * coalesce(nv, 0) + 0.3 * coalesce(nk, 0) END, 6) AS fused FROM f),
c AS (SELECT *, row_number() OVER (PARTITION BY query_id, paper ORDER BY fused DESC, rv NULLS LAST, rk NULLS LAST, doc_id) AS o FROM g QUALIFY o <= {4 * k}),
z AS (SELECT query_id, paper, doc_id, round(fused, 3) AS score, CAST(row_number() OVER (PARTITION BY query_id, paper ORDER BY o) AS INTEGER) AS rank FROM c JOIN ch USING (paper, doc_id) WHERE {where} QUALIFY rank <= {k})"""


def _paper_chunks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Labels are papers, languages their sections; benchmark items with a vector ask."""
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("section"))
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.col("label").alias("paper"))
    asked = read(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text").join(v.select("id", "v"), "id")
    return docs.join(v, "id"), asked


@query(paper_sql(3) + "SELECT * FROM z")
def paper_search(spark: SparkSession, d: str) -> DataFrame:
    chunks, asked = _paper_chunks(spark, d)
    return retrieval.paper_search(chunks, asked, 3).withColumn("score", F.round("score", 3))


@query(paper_sql(2, "section = 'en'") + "SELECT * FROM z")
def paper_section_search(spark: SparkSession, d: str) -> DataFrame:
    """The filter on the section comes after the candidates are fused, so a paper may give fewer rows than asked for."""
    chunks, asked = _paper_chunks(spark, d)
    return retrieval.paper_search(chunks, asked, 2, "en").withColumn("score", F.round("score", 3))


@query(paper_sql(4) + "SELECT query_id, CAST(10 - paper AS INTEGER) AS place, paper, doc_id, rank FROM z WHERE paper % 3 = 0")
def sampled_papers(spark: SparkSession, d: str) -> DataFrame:
    """Every third label is listed, from the last to the first; one listed paper has no chunks."""
    chunks, asked = _paper_chunks(spark, d)
    labels = chunks.select("paper").distinct().where("paper % 3 = 0")
    papers = labels.unionByName(spark.createDataFrame([(-3,)], "paper int")).select("paper", (10 - F.col("paper")).cast("int").alias("place"))
    return retrieval.sampled_papers(chunks, asked, papers, 4)


@query(f"""WITH {DENSE},
s AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round(list_dot_product(a.e, b.e), 6) AS score FROM n a JOIN n b ON a.vec_id % 20 = 0),
t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 10)
SELECT query_id, doc_id, round(CASE WHEN max(score) OVER w = min(score) OVER w THEN 1 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END, 4) AS norm
FROM t WINDOW w AS (PARTITION BY query_id)""")
def minmax_normalize(spark: SparkSession, d: str) -> DataFrame:
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    found = retrieval.dense_topk(v, v.where(F.col("id") % 20 == 0), 10)
    return retrieval.minmax(found).select("query_id", "doc_id", F.round("norm", 4).alias("norm"))


@query(f"""WITH {DENSE},
s AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round(list_dot_product(a.e, b.e), 6) AS score FROM n a JOIN n b ON a.vec_id % 20 = 0),
t AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 6),
g AS (SELECT query_id, rank - 1 AS rank, CAST(x.label = y.label AS INTEGER) AS rel FROM t JOIN embeddings x ON x.vec_id = query_id JOIN embeddings y ON y.vec_id = doc_id WHERE query_id <> doc_id),
p AS (SELECT query_id, max(rel) AS hit, coalesce(max(CASE WHEN rel = 1 THEN 1.0 / rank END), 0) AS rr, sum(rel / log2(rank + 1)) AS dcg, sum(rel) AS good FROM g WHERE rank <= 5 GROUP BY query_id),
z AS (SELECT *, CASE WHEN good > 0 THEN dcg / list_sum(list_transform(generate_series(1, CAST(good AS BIGINT)), lambda i: 1 / log2(i + 1))) ELSE 0 END AS ndcg FROM p)
SELECT round(avg(hit), 6) AS hit, round(avg(rr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg, count(*) AS queries FROM z""")
def hit_mrr_ndcg(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings")
    v = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    found = retrieval.dense_topk(v, v.where(F.col("id") % 20 == 0), 6).where("query_id <> doc_id").withColumn("rank", F.col("rank") - 1)
    label = e.select("vec_id", "label")
    found = found.join(label.withColumnsRenamed({"vec_id": "query_id", "label": "x"}), "query_id").join(label.withColumnsRenamed({"vec_id": "doc_id", "label": "y"}), "doc_id")
    return retrieval.ranking_metrics(found.withColumn("relevant", (F.col("x") == F.col("y")).cast("int")), 5)


# --- text --------------------------------------------------------------------


@query(r"""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS t FROM documents)
SELECT doc_id, md5(CASE WHEN t = '' THEN t ELSE t || chr(10) END) AS digest FROM t""")
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.md5(T.clean_text(F.col("text")).cast("binary")).alias("digest"))


@query(f"SELECT doc_id, len({TOKENS}) AS n_tokens, len(list_distinct({TOKENS})) AS n_distinct FROM documents")
def tokenize_stats(spark: SparkSession, d: str) -> DataFrame:
    w = T.tokens(F.col("text"))
    return read(spark, d, "documents").select("doc_id", F.size(w).cast("long").alias("n_tokens"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"))


@query("""SELECT page_id, regexp_replace(lower(url), '[^a-z0-9]', '', 'g') AS title_key, trim(regexp_replace(lower(url), '[^a-z0-9]+', ' ', 'g')) AS title_norm FROM pages""")
def title_keys(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", T.title_key(F.col("url")).alias("title_key"), T.title_norm(F.col("url")).alias("title_norm"))


@query(r"""SELECT page_id, nullif(regexp_replace(trim('https://DOI.org/10.1/' || page_id), '(?i)^https?://(dx\.)?doi\.org/', ''), '') AS doi,
lower(regexp_replace(regexp_extract('https://arxiv.org/abs/' || url || 'v2', 'arxiv\.org/(?:abs|pdf)/([^/?#\s]+)', 1), 'v[0-9]+$', '')) AS arxiv FROM pages""")
def doi_and_arxiv(spark: SparkSession, d: str) -> DataFrame:
    link = F.concat(F.lit("https://arxiv.org/abs/"), "url", F.lit("v2"))
    return read(spark, d, "pages").select("page_id", T.doi(F.concat(F.lit("https://DOI.org/10.1/"), F.col("page_id").cast("string"))).alias("doi"), T.arxiv_id(link).alias("arxiv"))


@query("""WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '[一-鿿]')) AS zh, len(regexp_extract_all(text, '[A-Za-z]')) AS la FROM documents)
SELECT doc_id, CASE WHEN zh = 0 AND la = 0 THEN 'unknown' WHEN zh > 0.35 * la AND la < 0.35 * zh THEN 'zh' WHEN zh < 0.08 * la THEN 'en' ELSE 'mixed' END AS label FROM c""")
def language_label(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", T.language_label(F.col("text")).alias("label"))


@query(r"""SELECT doc_id, CASE WHEN regexp_extract(text, '(?i)arxiv:\s*([0-9]{2})[0-9]{2}[.]', 1) <> '' THEN CAST(regexp_extract(text, '(?i)arxiv:\s*([0-9]{2})[0-9]{2}[.]', 1) AS INTEGER) + 2000
ELSE list_max(list_transform(regexp_extract_all(text, '\b(20[0-9]{2})', 1), lambda y: CAST(y AS INTEGER))) END AS year FROM documents""")
def publication_year(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", T.publication_year(F.col("text")).alias("year"))


@query("""SELECT conv_id, turn, CAST(greatest(1, least(5, coalesce(TRY_CAST(regexp_replace(text, '[^0-9]', '', 'g') AS BIGINT), 3))) AS INTEGER) AS score FROM conversations""")
def relevance_scores(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "conversations").select("conv_id", "turn", T.score_from_reply(F.col("text")).alias("score"))


def _any_of(words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + ")"


@query(f"""SELECT conv_id, turn, CASE WHEN {_any_of(P.CHAT_WORDS)} THEN 'chitchat' WHEN {_any_of(P.CATALOG_WORDS)} OR ({_any_of((P.INTRODUCE,))} AND {_any_of(P.LIBRARY_WORDS)} AND NOT {_any_of(P.HOW_WORDS)}) THEN 'catalog' ELSE 'qa' END AS intent FROM conversations WHERE role = 'user'""")
def intent_route(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", P.intent(F.col("text")).alias("intent"))


@query(r"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]+)"', 1)) AS href FROM pages)
SELECT page_id, count(*) AS n_links, count(DISTINCT href) AS n_distinct, min(href) AS first_href FROM a GROUP BY page_id""")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    href = F.explode(F.regexp_extract_all("html", F.lit(r'<a href="([^"]+)"'), F.lit(1)))
    a = read(spark, d, "pages").select("page_id", href.alias("href"))
    return a.groupBy("page_id").agg(F.count("*").alias("n_links"), F.countDistinct("href").alias("n_distinct"), F.min("href").alias("first_href"))


# --- chunks ------------------------------------------------------------------

CHUNKS = r"""
c AS (SELECT doc_id, text, unnest(generate_series(0, CAST(ceil(greatest(length(text) - 500, 0) / 450.0) AS BIGINT))) AS i FROM documents WHERE length(text) > 0),
k AS (SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, CAST(i * 450 AS INTEGER) AS start_char, CAST(least(i * 450 + 500, length(text)) AS INTEGER) AS end_char, substring(text, i * 450 + 1, 500) AS raw FROM c)"""


@query(rf"""WITH {CHUNKS}
SELECT doc_id, chunk_index, start_char, end_char, md5(CASE WHEN regexp_replace(raw, '^\s+|\s+$', '', 'g') = '' THEN raw ELSE regexp_replace(raw, '^\s+|\s+$', '', 'g') END) AS digest FROM k""")
def chunk_fixed_window(spark: SparkSession, d: str) -> DataFrame:
    c = chunking.chunk_text(read(spark, d, "documents"))
    return c.select("doc_id", "chunk_index", "start_char", "end_char", F.md5(F.col("content").cast("binary")).alias("digest"))


@query(f"""WITH {CHUNKS}
SELECT doc_id, chunk_index, CAST(end_char - start_char - greatest(coalesce(lag(end_char) OVER (PARTITION BY doc_id ORDER BY chunk_index) - start_char, 0), 0) AS INTEGER) AS fresh_chars FROM k""")
def overlap_removal(spark: SparkSession, d: str) -> DataFrame:
    return chunking.without_overlap(chunking.chunk_text(read(spark, d, "documents"))).select("doc_id", "chunk_index", "fresh_chars")


@query("""WITH p AS (SELECT conv_id, turn, text, unnest(generate_series(0, length(text) - 1, 80)) AS pos FROM conversations WHERE length(text) > 0)
SELECT conv_id * 1000 + turn AS doc_id, CAST(pos AS INTEGER) AS pos, substring(text, pos + 1, 80) AS piece FROM p""")
def token_slices(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    return chunking.slices(c)


# --- library -----------------------------------------------------------------


@query("""SELECT doc_id, source, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 20""")
def list_papers_page(spark: SparkSession, d: str) -> DataFrame:
    return library.page_of(read(spark, d, "documents").select("doc_id", "source", "n_chars"), [F.col("n_chars").desc(), F.col("doc_id")], 2, 20)


@query("""SELECT doc_id, source FROM documents WHERE text ILIKE '%ontion%' OR source ILIKE '%ontion%' OR lang ILIKE '%ontion%'""")
def list_papers_search(spark: SparkSession, d: str) -> DataFrame:
    like = lambda c: F.col(c).ilike("%ontion%")
    return read(spark, d, "documents").where(like("text") | like("source") | like("lang")).select("doc_id", "source")


@query("""SELECT doc_id, n_chars FROM documents WHERE lang = 'en' AND source = 'src1'""")
def optional_filters(spark: SparkSession, d: str) -> DataFrame:
    return library.optional_filters(read(spark, d, "documents"), lang="en", source="src1", n_chars=0).select("doc_id", "n_chars")


@query("""WITH r AS (SELECT coalesce(nullif(source, ''), 'unset') AS name, doc_id AS item, row_number() OVER (PARTITION BY coalesce(nullif(source, ''), 'unset') ORDER BY doc_id DESC) AS rank FROM documents)
SELECT name, count(*) AS n, string_agg(CAST(item AS VARCHAR), ',' ORDER BY item) FILTER (rank <= 5) AS newest, name = 'unset' AS unset FROM r GROUP BY name""")
def group_by_field(spark: SparkSession, d: str) -> DataFrame:
    return library.group_by_field(read(spark, d, "documents"), "source", "doc_id")


@query("SELECT DISTINCT source FROM documents WHERE source <> ''")
def distinct_fields(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").where("source <> ''").select("source").distinct()


@query("""SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(DISTINCT conv_id) FROM conversations) AS sessions, (SELECT count(*) FROM conversations WHERE role = 'user') AS questions, (SELECT count(*) FROM pages) AS pages""")
def dashboard_counts(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").agg(F.count("*").alias("documents"))
    conv = read(spark, d, "conversations").agg(F.countDistinct("conv_id").alias("sessions"), F.count_if(F.col("role") == "user").alias("questions"))
    return docs.join(F.broadcast(conv)).join(F.broadcast(read(spark, d, "pages").agg(F.count("*").alias("pages"))))  # one row each


@query("""WITH s AS (SELECT conv_id, coalesce(min_by(text, turn) FILTER (role = 'user'), CAST(conv_id AS VARCHAR)) AS t, max(turn) AS last_turn, count(*) AS n FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN length(t) > 30 THEN substring(t, 1, 30) || '...' ELSE t END AS title, last_turn, n FROM s""")
def session_list(spark: SparkSession, d: str) -> DataFrame:
    return library.sessions(read(spark, d, "conversations"))


@query("""SELECT conv_id, turn, role, back FROM (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS INTEGER) AS back FROM conversations) WHERE back <= 10""")
def memory_window(spark: SparkSession, d: str) -> DataFrame:
    return library.latest(read(spark, d, "conversations"), 10).select("conv_id", "turn", "role", "back")


@query("""WITH l AS (SELECT doc_id, CASE WHEN lang = 'en' AND source = 'nowhere' THEN 0 WHEN source = 'src3' THEN 1 ELSE 2 END AS level FROM documents)
SELECT doc_id, level FROM l WHERE level = (SELECT min(level) FROM l)""")
def filter_relaxation(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    return library.relaxed_filter(docs, (F.col("lang") == "en") & (F.col("source") == "nowhere"), [F.col("source") == "src3", F.lit(True)]).select("doc_id", "level")


@query("""WITH h AS (SELECT doc_id, contains(lower(replace(text, '-', ' ')), 'ontion the') AS hit FROM documents)
SELECT doc_id FROM h WHERE hit OR NOT (SELECT bool_or(hit) FROM h)""")
def phrase_filter(spark: SparkSession, d: str) -> DataFrame:
    hit = F.contains(F.lower(F.replace(F.col("text"), F.lit("-"), F.lit(" "))), F.lit("ontion the"))
    return library.keep_all_if_none(read(spark, d, "documents"), hit).select("doc_id")


@query(r"""WITH q AS (SELECT item_id, regexp_replace(lower(text), '[^\p{L}\p{N}_]+', '', 'g') AS quote, len(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}_]+'), lambda x: x <> '')) AS n FROM benchmark),
d AS (SELECT doc_id, regexp_replace(lower(text), '[^\p{L}\p{N}_]+', '', 'g') AS body FROM documents)
SELECT item_id, doc_id FROM q JOIN d ON contains(body, quote) WHERE n >= 6""")
def citation_verify(spark: SparkSession, d: str) -> DataFrame:
    return library.verify_quotes(read(spark, d, "benchmark"), read(spark, d, "documents"), min_words=6)


@query("""SELECT l.doc_id, l.toxic FROM labels l WHERE EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND d.lang = 'en')""")
def citation_semi(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "labels").join(read(spark, d, "documents").where("lang = 'en'"), "doc_id", "left_semi").select("doc_id", "toxic")


@query("""SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def orphan_anti_join(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id", "left_anti").select("doc_id", "source")


@query("""SELECT c_custkey, coalesce(n_name, '-') AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""")
def left_lookup(spark: SparkSession, d: str) -> DataFrame:
    c, n = read(spark, d, "customer"), read(spark, d, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey, "left").select("c_custkey", F.coalesce("n_name", F.lit("-")).alias("nation"))


@query("""SELECT doc_id, coalesce(quality, -1) AS quality, coalesce(toxic, CASE WHEN lang = 'en' THEN 0 END) AS toxic FROM documents LEFT JOIN labels USING (doc_id)""")
def enrich_left_update(spark: SparkSession, d: str) -> DataFrame:
    base = read(spark, d, "documents").select("doc_id", F.lit(None).cast("int").alias("quality"), F.lit(None).cast("int").alias("toxic"), "lang")
    out = federated.enrich(base, read(spark, d, "labels"), "doc_id", ["quality", "toxic"])
    return out.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.when(F.col("lang") == "en", 0)).alias("toxic"))


@query("""SELECT doc_id, quality, toxic FROM labels WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 1 AS quality, 0 AS toxic FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id % 2 = 0)""")
def upsert_rows(spark: SparkSession, d: str) -> DataFrame:
    base = read(spark, d, "documents").select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    return library.upsert(base, read(spark, d, "labels").where(F.col("doc_id") % 2 == 0).select("doc_id", "quality", "toxic"), ["doc_id"])


# --- federated ---------------------------------------------------------------


@query("""SELECT o_orderkey, o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'F' DESC, nullif(o_orderpriority, '4-NOT SPECIFIED') ASC NULLS LAST, o_totalprice DESC, o_orderkey) AS INTEGER) AS place FROM orders""")
def priority_sort(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").withColumn("published", F.col("o_orderstatus") == "F").withColumn("level", F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")))
    return federated.priority_sort(o, "o_custkey", "published", "level", "o_totalprice", "o_orderkey").select("o_orderkey", "o_custkey", "place")


@query("""WITH RECURSIVE r AS (SELECT lower(p_name || ' ' || p_brand) AS title, p_partkey AS id, p_size % 3 AS citations, p_type = 'SMALL' AS arxiv,
  row_number() OVER (PARTITION BY lower(p_name || ' ' || p_brand) ORDER BY p_partkey) AS k FROM part),
f AS (SELECT title, id, citations, arxiv, k FROM r WHERE k = 1 UNION ALL
  SELECT f.title, CASE WHEN w THEN f.id ELSE r.id END, CASE WHEN w THEN f.citations ELSE r.citations END, CASE WHEN w THEN f.arxiv ELSE r.arxiv END, r.k
  FROM f JOIN r ON r.title = f.title AND r.k = f.k + 1,
  LATERAL (SELECT CASE WHEN f.citations > 0 AND r.citations <= 0 THEN TRUE WHEN r.citations > 0 AND f.citations <= 0 THEN FALSE WHEN f.arxiv AND NOT r.arxiv THEN TRUE ELSE FALSE END AS w))
SELECT title, max_by(id, k) AS id, max_by(citations, k) AS citations, CAST(max(k) AS INTEGER) AS n FROM f GROUP BY title""")
def title_key_dedupe(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").select(F.lower(F.concat_ws(" ", "p_name", "p_brand")).alias("title"), F.col("p_partkey").alias("pos"), F.col("p_partkey").alias("id"), (F.col("p_size") % 3).alias("citations"), (F.col("p_type") == "SMALL").alias("arxiv"))
    return federated.dedupe(p, "title").drop("pos")


# --- events ------------------------------------------------------------------


@query("""SELECT user_id, max_by(event_type, (ts, event_id)) AS status, count(*) AS n, max(event_id) AS last_event FROM events GROUP BY user_id""")
def latest_status(spark: SparkSession, d: str) -> DataFrame:
    return progress.latest_status(read(spark, d, "events"))


@query("""WITH s AS (SELECT user_id, event_id, event_type, CAST(row_number() OVER w AS INTEGER) AS seq,
  coalesce(sum(CAST(event_type = 'purchase' AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over_
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, seq, event_id, event_type FROM s WHERE over_ = 0""")
def replay_events(spark: SparkSession, d: str) -> DataFrame:
    return progress.replay(read(spark, d, "events"))


@query("""SELECT event_type, min_by(event_id, (ts, event_id)) AS next_id FROM events GROUP BY event_type""")
def queue_fifo(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").groupBy("event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("next_id"))


@query("""WITH e AS (SELECT user_id, event_id, ts, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) <= 3600 THEN 0 ELSE 1 END AS new FROM events),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM e)
SELECT user_id, CAST(island AS BIGINT) AS island, count(*) AS n, min(event_id) AS first_id FROM g GROUP BY ALL HAVING count(*) >= 2""")
def gaps_islands(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(spark, d, "events").withColumn("before", F.lag("ts").over(w))
    e = e.withColumn("new", F.when(F.expr("timestampdiff(MICROSECOND, before, ts)") <= 3600 * 1_000_000, 0).otherwise(1))
    e = e.withColumn("island", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return e.groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id")).where("n >= 2")


# --- sections and pages ------------------------------------------------------


@query("""WITH s AS (SELECT DISTINCT l_orderkey, l_linenumber, l_linenumber % 3 AS level FROM lineitem)
SELECT l_orderkey, l_linenumber, level, (SELECT min(t.l_linenumber) FROM s t WHERE t.l_orderkey = s.l_orderkey AND t.l_linenumber > s.l_linenumber AND t.level <= s.level) AS next_ordinal FROM s""")
def section_subtree(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") % 3).alias("level")).distinct()
    return sections.subtree_ends(s, "l_orderkey", "l_linenumber", "level")


@query(f"SELECT doc_id, md5(array_to_string({TOKENS}, ' ')) AS digest FROM documents WHERE len({TOKENS}) > 0")
def inverted_abstract(spark: SparkSession, d: str) -> DataFrame:
    docs = sections.spread(read(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")
    w = docs.select("doc_id", F.posexplode(T.tokens(F.col("text"))).alias("pos", "word"))
    index = w.groupBy("doc_id", "word").agg(F.collect_list("pos").alias("positions"))
    out = sections.rebuild_inverted(index, "doc_id", "word", "positions")
    return out.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("""WITH s AS (SELECT conv_id, greatest(1, least(5, coalesce(TRY_CAST(regexp_replace(text, '[^0-9]', '', 'g') AS BIGINT), 3))) AS score FROM conversations)
SELECT conv_id, round(avg(score), 6) AS mean, CAST(max(score) AS INTEGER) AS best, avg(score) < 2 OR max(score) < 3 AS retry FROM s GROUP BY conv_id""")
def retry_decision(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "conversations").select("conv_id", T.score_from_reply(F.col("text")).alias("score"))
    out = s.groupBy("conv_id").agg(F.avg("score").alias("m"), F.max("score").alias("best"))
    return out.select("conv_id", F.round("m", 6).alias("mean"), "best", ((F.col("m") < 2) | (F.col("best") < 3)).alias("retry"))


@query(r"""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS t FROM documents),
c AS (SELECT doc_id, CASE WHEN t = '' THEN t ELSE t || chr(10) END AS t FROM t)
SELECT doc_id, CAST(ceil(greatest(length(t) - 500, 0) / 450.0) AS BIGINT) + 1 AS n_chunks, CAST(length(t) AS INTEGER) AS last_end FROM c WHERE length(t) > 0""")
def parsed_documents(spark: SparkSession, d: str) -> DataFrame:
    chunks = files.parsed(read(spark, d, "documents").select("doc_id", "text"))
    return chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.max("end_char").alias("last_end"))


@query()
def html_to_markdown(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", html.html_to_markdown("html").alias("markdown"))


from colophon.plans import audit_queries, desk_queries, figure_queries, layout_queries, library_queries, paged_queries, paper_queries, payload_queries, session_queries, source_queries, structure_queries  # noqa: E402, F401  (they register themselves)
