"""Mixing: the flow against all integer flows, and plans against a plain Python version of the contract."""

import itertools
import random
import re
import time
from fractions import Fraction

import pytest

from colophon.llm import mixing


def cost(total, supply):
    out, used = 0, 0
    while used < total:
        each, end = mixing.pass_cost(used, supply)
        out += each * (min(end, total) - used)
        used = min(end, total)
    return out


@pytest.mark.parametrize("seed", range(40))
def test_flow_is_the_cheapest(seed):
    rng = random.Random(seed)
    sources = "abc"
    patterns = rng.sample([("a",), ("b",), ("c",), ("a", "b"), ("b", "c"), ("a", "b", "c")], 3)
    supply = {p: rng.randrange(1, 3) for p in patterns}
    room = {(p, s): rng.randrange(0, 4) for p in patterns for s in p}
    quota = {s: rng.randrange(0, 4) for s in sources}
    flow = mixing.min_cost_flow(supply, quota, room)
    arcs = list(room)
    best = None
    for amounts in itertools.product(*(range(room[a] + 1) for a in arcs)):
        given = {s: sum(n for (_, t), n in zip(arcs, amounts, strict=True) if t == s) for s in sources}
        if all(given[s] <= quota[s] for s in sources):
            price = sum(cost(sum(n for (q, _), n in zip(arcs, amounts, strict=True) if q == p), supply[p]) for p in patterns)
            best = min(best, (-sum(amounts), price)) if best else (-sum(amounts), price)
    assert all(0 <= v <= room[k] for k, v in flow.items())
    assert all(sum(v for (_, t), v in flow.items() if t == s) <= quota[s] for s in sources)
    # as many words as possible, and those for the least cost
    assert (-sum(flow.values()), sum(cost(sum(v for (q, _), v in flow.items() if q == p), supply[p]) for p in patterns)) == best


def test_shared_text_serves_the_source_that_needs_it():
    flow = mixing.min_cost_flow({("a",): 10, ("a", "b"): 10}, {"a": 12, "b": 8})
    assert flow[("a", "b"), "b"] == 8 and sum(v for (_, s), v in flow.items() if s == "a") == 12
    assert flow[("a",), "a"] == 10  # no second pass where first passes are left


def plain_targets(sizes, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    left, free, out = Fraction(3, 2) * sum(sizes.values()), list(order), {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > 2 * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        out |= {s: Fraction(2 * sizes[s]) for s in over}
        left -= sum(2 * sizes[s] for s in over)
        free = [s for s in free if s not in over]
    return out


def check(docs):
    rows = docs.collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = {}
    for r in rows:
        total[r.source] = total.get(r.source, 0) + size(r.text)
    want = plain_targets(total)
    plan = mixing.plan_mix(docs)
    got = plan.collect()
    assert sorted((str(r.doc_id), r.size, str(r.source)) for r in got) == sorted((str(r.doc_id), size(r.text), str(r.source)) for r in rows)
    for s in total:
        mine = [r for r in got if r.source == s]
        assert {r.source_size for r in mine} == {total[s]} and mine[0].target == pytest.approx(float(want[s]))
        # rows that repeat an id and source are selected alike, which may take a word more
        assert abs(sum(r.taken for r in mine) - want[s]) <= 0.5 and all(0 <= r.taken <= 2 * r.size for r in mine)
    assert sorted(map(str, plan.collect())) == sorted(map(str, got))
    return got


def test_documents(spark):
    check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_overlapping_sources(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choices("abcdef", k=rng.randrange(1, 30))) for _ in range(60)]
    rows = [(i, rng.choice(texts[:40]), rng.choice(["a", "b", None])) for i in range(300)] + [(1000 + i, texts[40 + i % 20] + " x" * i, rng.choice("ab")) for i in range(100)]
    rows += [(5000, None, "c"), (5001, "", "c"), (5002, " \n", None), (None, "no id", "b")]
    got = check(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert any(len(r.pattern) > 1 for r in got)


def test_copies_wait_for_other_texts(spark):
    """Source a has ten copies of one text and ten others; of the copies one is taken before any repetition."""
    rows = [(i, "same words here", "a") for i in range(10)] + [(10 + i, f"text number {i}", "a") for i in range(10)] + [(100 + i, f"other text {i}", "b") for i in range(200)]
    got = {r.doc_id: r.taken for r in mixing.plan_mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1, 18), budget=Fraction(1)).collect()}
    # the target of a is a nineteenth of 660 words, about 35: eleven texts have 33
    assert all(got[10 + i] == 3 for i in range(10)) and sum(got[i] > 0 for i in range(10)) <= 2


def test_many_patterns_flow_in_seconds():
    """100,000 patterns over 60 sources: every quota is met, and no text is used twice while others of its sources are left."""
    rng = random.Random(8)
    names = [f"s{k:02d}" for k in range(60)]
    supply = {}
    while len(supply) < 100_000:
        supply.setdefault(tuple(sorted(rng.sample(names, rng.choice([1, 2, 2, 3, 5])))), rng.randrange(1, 60))
    own = {s: sum(n for p, n in supply.items() if s in p) for s in names}
    quota = {s: own[s] if i % 3 == 0 else own[s] // 9 for i, s in enumerate(names)}  # a third of the sources want all that they can reach
    begin = time.perf_counter()
    flow = mixing.min_cost_flow(supply, quota)
    assert time.perf_counter() - begin < 60
    got, used = dict.fromkeys(names, 0), dict.fromkeys(supply, 0)
    for (p, s), n in flow.items():
        assert 0 < n <= 2 * supply[p]
        got[s] += n
        used[p] += n
    assert got == quota


@pytest.mark.parametrize("seed", range(3))
def test_plans_joined_by_a_shuffle_are_the_same(spark, monkeypatch, seed):
    rng = random.Random(seed)
    rows = [(i, f"text {rng.randrange(40)} of some", rng.choice(["a", "b", "c", None])) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sent = sorted(map(str, mixing.plan_mix(df).collect()))
    monkeypatch.setattr(mixing, "SENT_UNITS", 0)
    check(df)
    assert sorted(map(str, mixing.plan_mix(df).collect())) == sent


def test_empty(spark):
    assert mixing.plan_mix(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []
