"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from colophon.llm import exact_dedup, jaccard_join, langid, line_dedup, mixing, packing, pii, substring_dedup, topk, toxicity

LINE = "This very line stands in five documents or even more of them."
ROWS = [
    (1, f"one\n{LINE}\nend", "en", "a"), (2, f"  {LINE.upper()}  \ntwo", "en", "a"), (3, f"{LINE}\nthree", "en", None), (4, LINE, "en", "b"),
    (5, f"{LINE}\n{LINE}", "en", "b"), (6, None, "en", "c"), (7, "", None, "c"), (8, "   \n\t", "de", None), (9, "alpha beta " * 30_000, "en", "a"),
    (10, "same text here", "en", "a"), (11, "same  text\nhere", "en", "a"), (11, "same  text\nhere", "en", "a"), (None, "no id at all", None, None),
]
EXTRA = ["_id", "__row", "n", "c", "shard", "id", "kind"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    for c in EXTRA:
        df = df.withColumn(c, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0), (2, 1), (2, 0), (None, 1), (4, None), (9, 7)], "doc_id long, toxic int")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


RUNS = {
    "toxicity": lambda d, lab: toxicity.toxic_scores(d, lab),
    "langid": lambda d, lab: langid.identify(d),
    "lines": lambda d, lab: line_dedup.dedup_lines(d),
    "mixing": lambda d, lab: mixing.plan_mix(d),
    "substring": lambda d, lab: substring_dedup.remove_repeats(d),
    "exact": lambda d, lab: exact_dedup.exact_groups(d),
    "pii": lambda d, lab: pii.digest(pii.find_spans(d)),
    "jaccard": lambda d, lab: jaccard_join.near_components(d),
}


@pytest.mark.parametrize("name", sorted(RUNS))
def test_a_row_for_each_row(docs, labels, name):
    assert len(RUNS[name](docs, labels).collect()) == len(ROWS)  # all columns are evaluated


@pytest.mark.parametrize("name", sorted(RUNS))
def test_empty_table(docs, labels, name):
    assert RUNS[name](docs.limit(0), labels.limit(0)).collect() == []


def test_packing_edges(docs):
    got = packing.pack(docs).collect()
    assert len({(r.doc_id, r.piece) for r in got}) == len(got) - 1  # document 11 stands twice
    assert by_id(packing.pack(docs.where("doc_id = 6")))[6].length == 1
    assert packing.pack(docs.limit(0)).count() == 0
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024


def test_lines(docs):
    got = by_id(line_dedup.dedup_lines(docs))
    assert [got[i].n_dropped for i in (1, 2, 3, 4, 5)] == [1, 1, 1, 1, 0]
    assert got[1].kept_text == "one\nend" and got[4].kept_text == "" and got[6].n_lines == 1 and got[5].n_lines == 2


def test_cuckoo_filter():
    import numpy as np

    h = np.random.default_rng(1).integers(-(2**62), 2**62, 20_000)
    f = line_dedup.CuckooFilter.build(h[:10_000])
    assert f.contains(h[:10_000]).all() and f.contains(h[10_000:]).mean() < 0.01
    f.delete(h[:5_000])
    assert f.contains(h[5_000:10_000]).all() and f.contains(h[:5_000]).mean() < 0.02


def test_exact(docs):
    got = by_id(exact_dedup.exact_groups(docs))
    # the longest original stays, and rows that share id and text share the mark
    assert got[10].keep_id == 11 and got[10].group_size == 3 and got[11].kept and not got[10].kept
    assert got[6].keep_id == 8 and got[7].group_size == 3 and got[8].kept


def test_exact_against_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, "".join(rng.choices(["a", "b ", " ", "\n", "é", ""], k=rng.randrange(5)))) for i in range(3000)] + [(5000 + i, "hot text") for i in range(1500)]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()}
    groups = {}
    for i, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text), []).append((-len(text), i))
    for norm, held in groups.items():
        best = min(held)[1]
        for _, i in held:
            assert got[i] == (best, len(held), i == best, hashlib.sha256(norm.encode()).hexdigest())


def test_runs_move_by_node_only(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = exact_dedup.merge_runs(exact_dedup.digest_runs(df))._jdf.queryExecution().executedPlan().toString()
    moves = re.findall(r"Exchange (\w+\([^)]*\))", plan)
    assert moves and all(re.match(r"hashpartitioning\(node#\d+, \d+\)", m) for m in moves), moves


def test_apply_mix_cuts_words(spark):
    d = spark.createDataFrame([(1, " one  two three ")], "doc_id long, text string")
    plan = spark.createDataFrame([(1, 3, 5)], "doc_id long, size long, taken long")
    assert sorted(r.text.split() for r in mixing.apply_mix(d, plan).collect()) == [["one", "two"], ["one", "two", "three"]]


def test_topk_edges(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (4, [0.5, None]), (5, [0.5, 0.5]), (5, [0.5, 0.5]), (None, [1.0, 1.0]), (100, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("x")).withColumn("v", F.lit(1))
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()]
    assert got[:4] == [(0, 1, 1, 1024 * 1024), (0, 2, 5, 512 * 1024), (0, 3, 5, 512 * 1024), (0, 4, 100, 0)]
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0


def test_topk_equal_vectors(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(40)] + [(i, [0.5, 0.1]) for i in range(100, 120)], "vec_id long, embedding array<float>")
    got = topk.top_k(df, F.col("vec_id") % 100 == 0).where("query_id = 0").orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(1, 11))  # the query's own row takes no place


def test_packing_islands_differ_and_meet(spark, monkeypatch):
    rng = random.Random(4)
    size = [rng.randrange(200, 700) for _ in range(300)]
    state = packing.start_plans(0, np.array(size, np.int32), 1024)
    assert (state["n_bins"] > state["bound"]).all() and len(set(state["plan"])) == packing.ISLANDS
    seen, epoch = [], packing._epoch
    monkeypatch.setattr(packing, "_epoch", lambda state, capacity, k, islands: seen.append(k) or epoch(state, capacity, k, islands))
    got = packing.pack_items(spark.createDataFrame([(0, i, s) for i, s in enumerate(size)], "shard int, idx int, size int")).collect()
    assert {0, 1} <= set(seen)  # elites met before the shard could leave
    fill = {}
    for r in got:
        fill[r.bin] = fill.get(r.bin, 0) + size[r.idx]
    assert len(got) == len(size) and max(fill.values()) <= 1024 and len(fill) <= state["n_bins"].min()


def test_pii(spark):
    text = "mail a.b@c.org_d@e.fr now 1.2.3.400 10.0.0.255, card 4111 1111 1111 1111, call +49 (30) 1234-5678. IBAN DE89370400440532013000 é ssn 123-45-6789"
    got = pii.digest(pii.find_spans(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert (got.n_email, got.n_ip, got.n_card, got.n_phone) == (2, 1, 1, 1)
    kinds = {s.split(":")[0]: tuple(map(int, s.split(":")[1:])) for s in got.spans.split(",")}
    assert text[slice(*kinds["iban"])] == "DE89370400440532013000" and text[slice(*kinds["ssn"])] == "123-45-6789" and text[slice(*kinds["ip"])] == "10.0.0.255"


def test_lines_of_repeated_rows(spark):
    docs = spark.createDataFrame([(1, f"one\n{LINE}"), (1, f"one\n{LINE}"), *[(i, LINE) for i in range(2, 7)]], "doc_id long, text string")
    got = [r for r in line_dedup.dedup_lines(docs).collect() if r.doc_id == 1]
    assert [(r.n_lines, r.n_dropped, r.kept_text) for r in got] == [(2, 1, "one")] * 2


def test_deobfuscation(spark):
    docs = spark.createDataFrame([(i, "you are a stupid loser and a moron here we go again") for i in range(200)], "doc_id long, text string")
    fix = toxicity.Restorer(toxicity.char_model(docs))
    for hidden in ("l0ser", "l o s e r", "looooser", "LO5ER", "l.o.s.e.r"):
        assert fix(hidden).lower() == "loser", hidden
    assert fix("stup1d m0ron") == "stupid moron" and fix("we go here") == "we go here"


def test_deobfuscation_combined(spark):
    plain = "you are a stupid loser and a moron we hate you here we go again"
    docs = spark.createDataFrame([(i, plain) for i in range(200)], "doc_id long, text string")
    fix = toxicity.Restorer(toxicity.char_model(docs))
    long = "you are a stupid loser and a moron we hate you"
    assert fix(" ".join(long.replace(" ", ""))) == long
    assert fix(" ".join(long.replace(" ", "")) * 40).count("stupid") == 40
    for hidden, shown in (
        ("l" + "o" * 70 + "ser", "loser"), ("l 0 s e r", "loser"), ("s t u p 1 d", "stupid"), ('"l o s e r"', '"loser"'), ("(l o s e r)", "(loser)"), ("lloosseerr", "loser"),
        ("l,o,s,e,r", "loser"), ("l   o   s   e   r", "loser"), ("ll oo ss ee rr", "loser"), ("l o s e r !", "loser !"), ("stup!!d", "stupid"), ("1 2 3 4 5", "1 2 3 4 5"), ("again! (here)", "again! (here)"),
    ):
        assert fix(hidden) == shown, (hidden, fix(hidden))
    rows = [("we l 0",), ("s e r m0ron",), ("",), ("l0ser",)]
    assert [t for held, _, _ in fix.chunks(iter(rows)) for (t,) in held] == ["we l 0", "ser moron", "", "loser"]
    docs = spark.createDataFrame([(i, "you ass you said has") for i in range(50)], "doc_id long, text string")
    assert toxicity.Restorer(toxicity.char_model(docs))("you a$$") == "you ass"


def test_suspects_hold_every_disguise():
    rng = random.Random(1)
    fix = toxicity.Restorer(np.zeros((64, 64, 64)))
    texts = ["".join(rng.choices("aabBos015$@!|+(€.,-_* '\"\n½éж漢", k=rng.randrange(1, 40))) for _ in range(20_000)]
    got = [r[0] for held, _, _ in fix.chunks((t,) for t in texts) for r in held]
    for raw, new in zip(texts, got, strict=True):
        assert fix.sub(raw) == new, (raw, new)


def test_toxicity_learns(spark):
    name = lambda i: "".join("abcdefghij"[int(c)] for c in str(i))
    rows = [(i, f"plain words x{name(i)} " * 3 + ("stupid loser" if i % 5 == 0 else "")) for i in range(400)] + [(1000, "quite st00pid l0ser indeed"), (1001, "quite plain words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)], "doc_id long, toxic int")
    got = by_id(toxicity.toxic_scores(docs, labels))
    assert got[1000].predicted == 1 and got[1001].predicted == 0
    assert all(got[i].predicted == int(i % 5 == 0) for i in range(400))


def test_langid_und(docs):
    got = by_id(langid.identify(docs))
    assert got[6].lang_pred == "und" and got[8].lang_pred == "und" and got[1].lang_pred == "en"


def test_substring(spark):
    a, b = "".join(chr(97 + i * i % 26) for i in range(40)) * 3, "Zq" * 75
    rows = [(1, a + "x" + b), (2, "y" + b + "é"), (3, None), (1, a + "x" + b), (4, "k" * 300)]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute([r for i, r in enumerate(rows) if i != 3])
    for r in got:
        assert (r.n_removed, hashlib.sha256(bytes(r.kept)).hexdigest()) == want[r.doc_id]


def test_substring_of_many_surroundings(spark):
    rng = random.Random(13)
    line = "A short line that stands in very many of the documents, é."
    longer = "B" + "".join(rng.choices("abcdef ", k=130))
    word = lambda: "".join(rng.choices("pqrstuvw ", k=rng.randrange(20, 90)))
    rows = [(i, "".join(word() + rng.choice([line, longer, line, ""]) for _ in range(rng.randrange(1, 6)))) for i in range(200)]
    rows += [(1000 + i, t[rng.randrange(len(t) // 2) :]) for i, t in rng.sample(rows, 40)]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    want = brute(rows)
    assert {r.doc_id: (r.n_removed, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got} == want


def test_substring_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    want = brute([tuple(r) for r in docs.collect()])
    got = substring_dedup.digest(substring_dedup.remove_repeats(docs)).collect()
    assert {r.doc_id: (r.n_removed, r.kept_sha256) for r in got} == want


def brute(rows):
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 99):
            w = data[i : i + 100]
            if w in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(w)
        out[doc_id] = sum(gone), hashlib.sha256(bytes(c for c, g in zip(data, gone, strict=True) if not g)).hexdigest()
    return out


def test_jaccard_small_sets(spark):
    import random

    rng = random.Random(3)
    rows = []
    for i in range(150):
        base = [f"w{rng.randrange(6)}" for _ in range(rng.randrange(0, 22))]
        rows.append((i, " ".join(base)))
        rows.append((1000 + i, " ".join(base + [f"w{rng.randrange(6)}"] * rng.randrange(2))))
    for num, den, words in ((85, 100, 4), (80, 100, 5), (50, 100, 2)):
        df = jaccard_join.near_components(spark.createDataFrame(rows, "doc_id long, text string"), num=num, den=den, words=words)
        got = {r.doc_id: r.component_id for r in df.collect()}
        assert got == brute_components(rows, num, den, words)


def brute_components(rows, num, den, words):
    sets = {}
    for i, t in rows:
        w = t.split()
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_pipeline_stages(spark, docs):
    current = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, current, "/root/testdata/sf0.001")
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == list(corpus_pipeline.COLUMNS)
        assert stage(spark, current.limit(0), "/root/testdata/sf0.001").count() == 0
        current = corpus_pipeline.keep(out, "test")
    assert current.count() > 0
