"""Learned operators on held-out rows, packing against the tokeniser, and each pipeline stage against plain Python."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from colophon.llm import langid, packing, queries, tokens

from .test_edges import brute_components
from .test_lines import brute as brute_lines
from .test_mixing import plain_targets

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_toxicity_held_out(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    got = queries.op1_toxicity(spark, SF).join(labels, "doc_id").where("held_out AND toxic IS NOT NULL").collect()
    toxic, clean = [r for r in got if r.toxic == 1], [r for r in got if r.toxic == 0]
    assert sum(r.predicted for r in toxic) >= 0.5 * len(toxic) and sum(r.predicted for r in clean) <= 0.05 * len(clean)


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text")
    got = queries.op3_langid(spark, SF).join(docs, "doc_id").where("held_out AND lang IS NOT NULL").collect()
    got = [r for r in got if re.search(r"[^\W\d_]", r.text or "")]
    assert sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)


def test_language_filter_against_exact_sets():
    """Popcounts less false positives come near the counts of exact n-gram sets."""
    rng = np.random.default_rng(2)
    grams = [np.unique(rng.integers(0, langid.CODES, 2000)) for _ in range(5)]
    size = 1 << 15
    table = np.zeros(size, np.uint64)
    for bit, g in enumerate(grams):
        for k in range(langid.HASHES):
            np.bitwise_or.at(table, langid.slots(g, k, size), np.uint64(1 << bit))
    model = langid.LanguageFilter(list("abcde"), "a", table)
    for want, g in enumerate(grams):
        mask = model.masks(g)[0]
        assert ((mask >> np.uint64(want)) & np.uint64(1)).all()  # no n-gram is lost
        text = np.concatenate([rng.choice(g, 60), rng.integers(0, langid.CODES, 40)])
        names, score = model.decide(text, np.zeros(len(text), np.int64), 1)
        exact = [np.isin(text, h).sum() for h in grams]
        assert names == ["abcde"[int(np.argmax(exact))]] and abs(score[0] - 1) < 0.35


def test_many_languages(spark):
    """200 languages, each of its own letters: masks of four words, filters that are not filled, held-out texts told apart."""
    rng = random.Random(9)
    letters = [chr(c) for c in range(0x61, 0x7B)] + [chr(c) for c in range(0x3B1, 0x3C9)] + [chr(c) for c in range(0x430, 0x44F)]
    words = {f"l{k:03d}": ["".join(rng.choices(rng.sample(letters, 12), k=rng.randrange(4, 9))) for _ in range(40)] for k in range(200)}
    rows = [(i, lang, " ".join(rng.choices(w, k=60))) for lang, w in words.items() for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = langid.learn(df.where("doc_id < 4"))
    assert model.table.shape[0] == 4 and model.fill.max() < 0.5
    asked = df.where("doc_id >= 4").select(F.concat("lang", F.col("doc_id").cast("string")).alias("k"), "text", "lang", F.monotonically_increasing_id().alias("doc_id")).persist()
    got = langid.predict(asked.select("doc_id", "text"), model).join(asked.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == 400 and sum(r.lang == r.lang_pred for r in got) >= 396


def test_full_filters_stay_below_half():
    """Slots follow the n-grams: a language that holds all of a million of them fills a third of its filter."""
    grams = np.arange(1 << 20)
    size = 1 << 23
    table = np.zeros(size, np.uint64)
    for k in range(langid.HASHES):
        table[langid.slots(grams, k, size)] = 1
    model = langid.LanguageFilter(["a"], "a", table)
    assert model.fill[0] < 0.5 and model.false_rate[0] < 0.1 and model.masks(grams[::1000]).all()


def texts_of_all_kinds():
    rng = random.Random(12)
    parts = ["word", " ", "  ", "\n", "\t", "it's", "Don't", "don’t", "12,345.6", "é", "ß", "漢字", "\U0001f600", "‍", "<|endoftext|>", "x" * 300, "á", " ", "Ω", "\r\n", "...", "http://a.b/c?d=e", "\x00", "ǆ", "ſ"]
    return ["".join(rng.choices(parts, k=rng.randrange(30))) for _ in range(3000)] + ["", " ", "<|endoftext|>"]


def test_both_tokenisers_agree(spark, tokenizer):
    texts = texts_of_all_kinds() + [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    folder = tokens.tokenizer_folder()
    for text, fast in zip(texts, tokens.byte_ids(texts, folder), strict=True):
        assert list(fast) == tokenizer.encode(text, add_special_tokens=False).ids, text[:200]


@pytest.mark.parametrize("kind", [" ", "\n", "\t", " \n"])
def test_long_white_space(spark, tokenizer, kind):
    """Runs that exhaust the faster library's stack are packed, and just as the tokeniser has them."""
    short, long = "a" + kind * 15_000 + "b", kind * ((5_000_000 if kind == "\n" else 1_500_000) // len(kind))
    folder = tokens.tokenizer_folder()
    assert list(tokens.byte_ids([short], folder)[0]) == tokenizer.encode(short, add_special_tokens=False).ids
    n = len(tokenizer.encode(long, add_special_tokens=False).ids)
    got = packing.pieces(spark.createDataFrame([(1, long)], "doc_id long, text string")).agg(F.sum("length")).first()[0]
    assert got == n + 1


def check_packing(docs, rows, tokenizer):
    """The contract of op10: every document's ids stand in its pieces, and every sequence is gapless."""
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == {i for i, _ in docs}
    for i, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        mine = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine))) and sum(r.length for r in mine) == len(ids)
        assert len(mine) == -(-len(ids) // 1024) and all(r.length == 1024 for r in mine[1:])
        at = 0
        for r in mine:
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
    total = 0
    for held in by_seq.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
        total += at
    return len(by_seq), -(-total // 1024)


def test_packing_whole_table(spark, tokenizer):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    n, bound = check_packing(docs, queries.op10_packing(spark, SF).collect(), tokenizer)
    assert n <= 1.01 * bound + 1


@pytest.fixture(scope="module")
def small(spark):
    rng = random.Random(21)
    lines = [f"This is the shared line number {i} with more than forty characters" for i in range(6)]
    rows = []
    for i in range(90):
        words = [f"word{rng.randrange(400)}" for _ in range(rng.randrange(1, 80))]
        text = " ".join(words) + "\n" + "\n".join(rng.sample(lines, rng.randrange(0, 3)))
        rows.append((i, text, "en", rng.choice(["web", "books", None]), len(text)))
        if i % 5 == 0:
            rows.append((1000 + i, text + " tail", "en", "web", len(text) + 5))
    rows += [(5000, None, None, "web", None), (5001, "", "en", "books", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stage_toxicity(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    given, kept = texts(docs), texts(corpus_pipeline.toxicity_filter(spark, docs, "/root/testdata/sf0.001"))
    assert all(kept[i] == given[i] for i in kept)
    gone = given.keys() - kept.keys()
    clean = [i for i in given if labels.get(i) == 0]
    assert sum(i in kept for i in clean) >= 0.95 * len(clean) and all(labels.get(i) != 0 for i in gone) and gone


def test_stage_line_dedup(spark, small):
    out = corpus_pipeline.line_dedup_stage(spark, small, SF)
    drop, kept = brute_lines(texts(small)), texts(out)
    for i, text in texts(small).items():
        assert kept[i] == "\n".join(x for k, x in enumerate((text or "").split("\n")) if k not in drop.get(i, ()))
    assert drop and all(r.n_chars == len(r.text) for r in out.collect())


def test_stage_jaccard_join(spark, small):
    kept = corpus_pipeline.near_dedup_stage(spark, small, SF)
    groups = brute_components([(i, t or "") for i, t in texts(small).items()], 80, 100, 5)
    assert texts(kept) == {i: t for i, t in texts(small).items() if groups[i] == i} and kept.count() < small.count()


def test_stage_mixing(spark, small):
    size = lambda t: len((t or "").split())
    given, out = {r.doc_id: r for r in small.collect()}, corpus_pipeline.mixing_stage(spark, small, SF).collect()
    total = {}
    for r in given.values():
        total[r.source] = total.get(r.source, 0) + size(r.text)
    target = plain_targets(total)
    for s in total:
        assert abs(sum(size(r.text) for r in out if r.source == s) - target[s]) <= 0.5
    for r in out:
        assert given[r.doc_id].text.startswith(r.text) and r.n_chars == len(r.text)


def test_stage_packing(spark, small, tokenizer):
    check_packing([(r.doc_id, r.text) for r in small.collect()], corpus_pipeline.packing_stage(spark, small, SF).collect(), tokenizer)


def test_stages_follow_each_other(spark):
    """run() is the stages in their order: the same rows as one after the other by hand."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.keep(stage(spark, docs, "/root/testdata/sf0.001"), "by-hand")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    run = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, run.select(columns).collect())) == sorted(map(tuple, docs.select(columns).collect()))
    assert run.where(F.col("offset") < 0).count() == 0
