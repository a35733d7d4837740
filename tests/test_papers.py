"""Truth tables of the paper rules, folds, matches and job states."""

import math
import random
import re

from pyspark.sql import functions as F

from colophon.functions import papers as P
from colophon.functions import venues as V
from colophon.operators import folds, matching, outline, retrieval
from colophon.plans import paper_queries, registry
from colophon.plans.library_queries import job_events
from colophon.streaming import jobs

SF = "/root/testdata/sf0.001"


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", f(F.col("v")).alias("out"))
    return [r.out for r in rows.orderBy("i").collect()]


def test_headings(spark):
    assert column(spark, [None, "IV", "B", "2", "2.1", "2.1.3.4"], P.heading_level) == [1, 1, 2, 1, 2, 3]
    assert column(spark, ["3.1 Our Method", "IV. Results", "A. Setup", "Plain", "", None], P.slug) == ["our_method", "results", "setup", "plain", "other", "other"]
    long = "4. We can find that the model beats all of them"
    assert column(spark, [long, "4. We can find", "", None, "Method"], P.body_sentence) == [True, False, True, True, False]


def test_table_rows(spark):
    assert column(spark, ["0.1 0.2", "a \u00b1 3", "PSNR and SSIM", "PSNR PSNR", "text"], P.table_row) == [True, True, True, False, False]


def test_venues(spark):
    got = column(spark, ["CVPR 2023", "Proc. NAACL", "Pattern Recognition", "MVA", "Nature", "", None], V.venue_level)
    assert got == ["A", "B", "B", "C", None, None, None]
    assert column(spark, ["ICML", "ECML-PKDD", "Nature", None], V.open_source) == ["pmlr", "pmlr", None, None]


def test_years_plans_labels(spark):
    assert column(spark, ["2020", "1899", "x", None], P.year) == [2020, None, None, None]
    assert column(spark, ["0", "3", "10", "30", "100"], lambda c: P.evidence_plan(c.cast("int"))) == [0, 3, 2, 1, 1]
    assert column(spark, ['"Vision".\nmore', "", None], P.field_label) == ["Vision", "other", "other"]
    assert column(spark, ["x {\"k\": 3} y", "none", None], lambda c: P.json_object(c, "k int")["k"]) == [3, None, None]


def test_titles(spark):
    q = spark.createDataFrame([(1, "How good is FGGD-PC?"), (2, "does swinir win"), (3, "deep learning"), (4, None)], "query_id long, text string")
    t = spark.createDataFrame([(7, "Fast graph-guided denoising for point clouds"), (8, "SwinIR for deep learning"), (9, None)], "paper_id long, title string")
    assert [tuple(r) for r in matching.title_mentions(q, t).collect()] == [(2, 8)]
    assert [tuple(r) for r in matching.abbreviation_mentions(q, t).collect()] == [(1, 7)]


def test_keep_group_if_none(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 3), (2, 4)], "g int, x int")
    assert sorted(r.x for r in matching.keep_group_if_none(df, "g", F.col("x") == 1).collect()) == [1, 3, 4]


def test_folds(spark):
    df = spark.createDataFrame([(1, 0, "a", 5), (1, 1, "a", 4), (1, 2, "a", 5), (1, 3, "b", 1), (None, 0, "a", 9)], "k int, i int, label string, size int")
    got = {(r.k, r.i): r.unit for r in folds.merge_pieces(df, "k", ["i"], "label", "size", 10).collect()}
    assert got == {(1, 0): 0, (1, 1): 0, (1, 2): 1, (1, 3): 2, (None, 0): 0}
    got = {(r.k, r.i): r.taken for r in folds.fill_budget(df, "k", ["i"], "size", 10).collect()}
    assert got == {(1, 0): True, (1, 1): True, (1, 2): False, (1, 3): True, (None, 0): True}
    assert folds.fill_budget(df.limit(0), "k", ["i"], "size", 10).count() == 0


def test_section_ends(spark):
    df = spark.createDataFrame([(1, 0, 1, 0, 9), (1, 1, 3, 5, 9), (1, 2, 3, 9, 9), (1, 3, 5, 0, 9)], "k int, ordinal int, page int, offset int, last_page int")
    assert [r.page_end for r in outline.section_ends(df, "k").orderBy("ordinal").collect()] == [3, 3, 4, 9]


def test_per_paper_topk(spark):
    c = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [0.0, 1.0], 1), (3, [1.0, 1.0], 2)], "id long, v array<double>, paper int")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "id long, v array<double>")
    assert sorted((r.paper, r.doc_id, r["rank"]) for r in retrieval.per_paper_topk(c, q, 1).collect()) == [(1, 1, 1), (2, 3, 1)]
    assert retrieval.per_paper_topk(c.limit(0), q, 1).count() == 0


def test_job_steps():
    assert jobs.step("pending", 0, "advance") == ("downloading", 10)
    assert jobs.step("parsing", 50, "fail") == ("failed", 50)
    assert jobs.step("parsing", 50, "retry") == ("parsing", 50)
    assert jobs.step("done", 100, "retry") == ("pending", 0)
    assert jobs.step("done", 100, None) == ("done", 100)


def test_job_stream_equals_batch(spark):
    batch = spark.read.parquet(f"{SF}/events.parquet")
    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(SF)
    q = jobs.job_stream(job_events(stream)).writeStream.outputMode("update").format("memory").queryName("jobs_test").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("jobs_test").collect())) == sorted(map(tuple, jobs.job_states(job_events(batch)).collect()))


def test_intents(spark):

    rows = [("你好", "chitchat"), ("What is this", "chitchat"), ("有哪些论文", "catalog"), ("介绍一下论文库", "catalog"), ("介绍论文库的方法", "qa"), ("explain", "qa"), (None, "qa")]
    df = spark.createDataFrame(rows, "t string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", P.intent(F.col("t"))).collect())
    text = "PSNR SSIM Set5\nSSIM and PSNR rise on all the sets here\n1.25 2.50 3.75 99\nplain"
    assert spark.createDataFrame([(text,)], "t string").select(P.without_table_rows(F.col("t"))).first()[0] == "SSIM and PSNR rise on all the sets here\nplain"


def test_parts_of_outlines_follow_the_lines(spark, tmp_path, monkeypatch):
    """Sections and pages of many orders are dealt into parts of bounded size once; no later step gathers them into fewer."""
    rows = [(k, i, 7 * k + i, float(i)) for k in range(40) for i in range(1, 4)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(paper_queries, "OUTLINE_LINES", 10, raising=False)
    for name in ("owner_of_pages", "section_of_pages"):
        out = registry.QUERIES[name](spark, str(tmp_path))
        assert out.count() == 360
        exchanges = re.findall(r"Exchange hashpartitioning\(.*?, (\d+)\)", out._jdf.queryExecution().executedPlan().toString())
        assert exchanges and set(exchanges) == {"12"}


def test_inverted_index_shuffles_texts_only(spark, tmp_path):
    spark.createDataFrame([(i, "b a b " * i) for i in range(5)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = registry.QUERIES["inverted_abstract"](spark, str(tmp_path))
    assert out.count() == 4
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1


def test_keyword_search_within_papers(spark, monkeypatch):
    """Long papers in several parts and several papers in one; queries without a shared term, texts without words, repeated words."""
    rng = random.Random(4)
    for name, value in (("PART_WORDS", 60), ("PAPER_WORDS", 20), ("QUERY_BLOCK", 2)):
        monkeypatch.setattr(retrieval, name, value, raising=False)
    text = lambda n: " ".join(rng.choice("the the the of a b c d e f g h".split()) for _ in range(n))
    chunks = [(i, min(rng.randrange(12), 5), rng.choice([text(rng.randrange(12)), text(8), "", None])) for i in range(150)] + [(900, None, "the")]
    queries = [(1, "the of the a"), (2, "h g"), (3, "nothing here"), (4, ""), (5, "the")]
    out = retrieval.paper_bm25(spark.createDataFrame(chunks, "id long, paper int, text string"), spark.createDataFrame(queries, "id long, text string"), 4)
    exchanges = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", out._jdf.queryExecution().executedPlan().toString())
    assert exchanges and not any("doc_id" in e for e in exchanges)  # pairs of queries and chunks are not shuffled
    want = []
    for paper in range(6):
        docs = {i: (t or "").split() for i, p, t in chunks if p == paper}
        known = [len((t or "").split()) for _, p, t in chunks if p == paper and t is not None]
        df = {w: sum(w in d for d in docs.values()) for d in docs.values() for w in d}
        raw = {w: math.log(len(docs) - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
        idf = {w: x if x >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, x in raw.items()}
        mean = sum(known) / len(known)
        for q, asked in queries:
            score = {i: round(sum(idf[w] * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / mean)) for w in asked.split() if w in d), 6) for i, d in docs.items()}
            want += [(q, paper, i, r) for r, i in enumerate(sorted(score, key=lambda i: (-score[i], i))[:4], 1)]
    assert sorted((r.query_id, r.paper, r.doc_id, r["rank"]) for r in out.collect()) == sorted(want)


def test_terms_of_a_paper_are_dealt_into_parts(spark, monkeypatch):
    """No join gathers a paper's terms in one group, however few papers there are; the lists are those of whole papers."""
    rng = random.Random(5)
    chunks = [(i, i % 3, " ".join(f"t{rng.randrange(60)}" for _ in range(rng.randrange(20)))) for i in range(200)]
    queries = [(i, " ".join(f"t{rng.randrange(70)}" for _ in range(5))) for i in range(6)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lists = []
        for words in (1 << 19, 40):
            monkeypatch.setattr(retrieval, "PART_WORDS", words)
            monkeypatch.setattr(retrieval, "PAPER_WORDS", words // 4)
            out = retrieval.paper_bm25(spark.createDataFrame(chunks, "id long, paper int, text string"), spark.createDataFrame(queries, "id long, text string"), 4)
            keys = re.findall(r"SortMergeJoin \[(.*?)\], \[", out._jdf.queryExecution().executedPlan().toString())
            assert keys and not [k for k in keys if re.fullmatch(r"paper#\d+L?", k)]
            lists.append(sorted((r.query_id, r.paper, r.doc_id, r.score, r["rank"]) for r in out.collect()))
        assert len(lists[0]) == 72 and lists[0] == lists[1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
