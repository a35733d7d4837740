"""Mixing sources to target weights as a min-cost flow.

Sources overlap where the same text stands in several of them.  Documents are
aggregated by membership pattern: the set of sources that hold a document's
text.  A pattern supplies its different texts' words; arcs run from it to the
quota of each of its sources, at most ``passes`` times the words that the source
itself has of the pattern.  Words beyond a pattern's first pass over its texts
cost more, and each further pass more again (convex repetition costs), whichever
source asks for them.  So a text that two sources share serves the one that
needs it most, and is repeated only where other texts run out.

Selection is seeded: within a pattern and source, documents are ordered by a hash
of the seed and their id, one of each text first, and the plan's share is taken from the front; the one
document at the border gives its first words.

Nothing but sums by (pattern, source) reaches the driver, where the flow runs on
arrays: every pattern takes part, whatever their number.  Its paths run between sources and
move words of all their common patterns at once.  Sources are at most ``MAX_SOURCES``, which is checked.  Running sums over documents use two
levels of hash buckets, so no task sorts a whole source, and texts with many
copies are told to the documents by a bounded broadcast.

Defined results: null text has size 0; a null source is its own source, after
all others; documents of size 0 take 0 words; repeated rows are documents of
their own, but rows with the same id and source are selected alike, ordered by
size; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections import deque
from collections.abc import Callable
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, join_hot, keep

#: Weights of the sources by code point, repeating; null comes last.
WEIGHTS = (5, 2, 1)
#: The mix holds this share of all words.
BUDGET = Fraction(3, 2)
MAX_PASSES = 2
#: Sources at most, which is checked.
MAX_SOURCES = 1_000_000
#: Rows a (pattern, source) up to which the plan is sent to every task; more are joined by a shuffle.
SENT_UNITS = 100_000
_BUCKETS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fair_targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, budget: Fraction = BUDGET, passes: int = MAX_PASSES) -> dict[str | None, Fraction]:
    """Targets by weight; none above ``passes`` times its source, the excess reshared by weight."""
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    cap = {s: Fraction(passes * n) for s, n in order}
    left, free, target = budget * sum(n for _, n in order), set(weight), {}
    while free:
        unit = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * unit > cap[s]}
        if not full:
            target |= {s: weight[s] * unit for s in free}
            break
        target |= {s: cap[s] for s in full}
        left -= sum(cap[s] for s in full)
        free -= full
    return target


def pass_cost(used: int, supply: int) -> tuple[int, int]:
    """The cost of a pattern's next word, and the words used when it rises.

    Passes 1, 2, 3 and 4 cost 1, 4, 9 and 16 a word; from there the cost rises
    whenever the passes double.
    """
    k = 0
    while used >= supply * level_end(k):
        k += 1
    return (k + 1) ** 2, supply * level_end(k)


def level_end(k: int) -> int:
    """The passes after which words cost more than (k + 1) ** 2."""
    return k + 1 if k < 4 else 1 << (k - 1)


class Flow:
    """Words that patterns give to sources: one array entry an arc, arcs in the order of their sources."""

    def __init__(self, supply: np.ndarray, need: np.ndarray, pattern: np.ndarray, source: np.ndarray, room: np.ndarray):
        self.supply, self.need = supply, need.copy()
        self.pattern, self.source, self.room = pattern, source, room
        self.begin = np.searchsorted(source, np.arange(len(need) + 1))
        self.flow, self.used = np.zeros(len(room), np.int64), np.zeros(len(supply), np.int64)
        self.most = np.bincount(pattern, room, len(supply)).astype(np.int64)
        self.cap = np.zeros(len(supply), np.int64)

    def arcs(self, s: int) -> slice:
        return slice(self.begin[s], self.begin[s + 1])

    def free(self, s: int) -> np.ndarray:
        """What each arc of ``s`` can still bring at this level."""
        at = self.arcs(s)
        p = self.pattern[at]
        return np.minimum(self.room[at] - self.flow[at], self.cap[p] - self.used[p])

    def given_up(self, s: int, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(arcs of s, arcs of t, words): what s can take from t, pattern by pattern."""
        i, j = (np.arange(self.begin[x], self.begin[x + 1]) for x in (s, t))
        _, x, y = np.intersect1d(self.pattern[i], self.pattern[j], assume_unique=True, return_indices=True)
        i, j = i[x], j[y]
        return i, j, np.minimum(self.room[i] - self.flow[i], self.flow[j])

    def path(self, s: int) -> list[int] | None:
        """Sources from ``s`` to one with free words, each taking from the next."""
        before, queue = {s: -1}, deque([s])
        while queue:
            t = queue.popleft()
            at = self.arcs(t)
            if (self.free(t) > 0).any():
                way = [t]
                while before[way[-1]] >= 0:
                    way.append(before[way[-1]])
                return way[::-1]
            wanted = np.zeros(len(self.supply), bool)
            wanted[self.pattern[at][self.room[at] > self.flow[at]]] = True
            for u in np.unique(self.source[wanted[self.pattern] & (self.flow > 0)]).tolist():
                if u not in before:
                    before[u] = t
                    queue.append(u)
        return None

    @staticmethod
    def shared_out(words: np.ndarray, amount: int) -> np.ndarray:
        """``amount`` taken from the front of ``words``."""
        done = np.cumsum(words)
        return np.clip(amount - (done - words), 0, words)

    def augment(self, s: int) -> bool:
        way = self.path(s)
        if way is None:
            return False
        amount = min(int(self.need[s]), int(self.free(way[-1]).sum()), *(int(self.given_up(a, b)[2].sum()) for a, b in zip(way, way[1:], strict=False)))
        at, more = self.arcs(way[-1]), self.shared_out(self.free(way[-1]), amount)
        self.flow[at] += more
        self.used[self.pattern[at]] += more
        for a, b in reversed(list(zip(way, way[1:], strict=False))):
            i, j, words = self.given_up(a, b)
            moved = self.shared_out(words, amount)
            self.flow[i] += moved
            self.flow[j] -= moved
        self.need[s] -= amount
        return True

    def run(self) -> None:
        """A largest flow at each cost, cheapest words first; a pattern's cost depends on its whole use, so moving words between sources costs nothing."""
        for k in itertools.count():
            self.cap = np.minimum(self.supply * level_end(k), self.most)
            for s in range(len(self.need)):
                while self.need[s] > 0 and self.augment(s):
                    pass
            if not self.need.any() or (self.cap == self.most).all():
                return


def min_cost_flow(supply: dict[tuple, int], quota: dict[str | None, int], room: dict[tuple[tuple, str | None], int] | None = None, passes: int = MAX_PASSES) -> dict[tuple[tuple, str | None], int]:
    """Words that each pattern gives to each of its sources.

    ``room``: the most that a source takes of a pattern (default: ``passes``
    times its supply).  Paths run between sources: along one, each source takes
    words of any number of patterns from the next, so their number follows the
    sources and not the patterns.
    """
    if room is None:
        room = {(p, s): passes * n for p, n in supply.items() for s in p}
    sources = {s: i for i, s in enumerate(sorted(quota, key=lambda s: (s is None, s or "")))}
    patterns = {p: i for i, p in enumerate(supply)}
    arcs = sorted(((sources[s], patterns[p], n) for (p, s), n in room.items() if n > 0 and supply[p] > 0 and s in sources))
    source, pattern, most = (np.array(x, np.int64) for x in zip(*arcs, strict=True)) if arcs else (np.zeros(0, np.int64),) * 3
    net = Flow(np.array(list(supply.values()), np.int64), np.array([quota[s] for s in sources], np.int64), pattern, source, most)
    net.run()
    names, given = list(patterns), list(sources)
    return {(names[p], given[s]): int(n) for s, p, n in zip(source.tolist(), pattern.tolist(), net.flow.tolist(), strict=True) if n}


def membership(df: DataFrame) -> DataFrame:
    """``df`` (id, size, source, h, t1, t2) with ``pattern`` and ``again`` (another row stands for the text in this source)."""
    held = df.groupBy("t1", "t2", "source").agg(F.count("*").alias("n"), F.min(F.struct("h", "id")).alias("first"), F.max("size").alias("size"))
    texts = held.groupBy("t1", "t2").agg(F.sum("n").alias("n"), F.max("size").alias("size"), F.collect_list(F.struct("source", "first")).alias("members"))
    texts = keep(texts.where("n > 1 AND size > 0").drop("size"), "mix-texts")
    both = join_hot(df, texts, ["t1", "t2"], "n", df.count(), "left")
    mine = F.get(F.filter("members", lambda m: m.source.eqNullSafe(F.col("source"))), F.lit(0)).first
    pattern = F.when(F.col("members").isNull(), F.array("source")).otherwise(F.array_sort(F.transform("members", lambda m: m.source)))
    return both.select("id", "size", "source", "h", "t1", "t2", pattern.alias("pattern"), F.when(F.col("members").isNull(), False).otherwise(~mine.id.eqNullSafe(F.col("id"))).alias("again"))


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, weights: tuple[int, ...] = WEIGHTS, budget: Fraction = BUDGET, passes: int = MAX_PASSES) -> DataFrame:
    """(id, size, source, pattern, source_size, target, taken): ``taken`` words of each document."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.col(id_col).alias("id"), word_count(F.col(text_col)).alias("size"), F.col(source_col).alias("source"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(seed), text).alias("t2"))
    # the sign bit is free: rows that repeat a text of their source come behind all others
    df = keep(df.withColumn("h", F.xxhash64(F.lit(seed), F.col("id"), F.col("source"))), "mix-sizes")
    df = membership(df).withColumn("h", F.shiftrightunsigned("h", 1).bitwiseOR(F.when(F.col("again"), F.lit(-(1 << 63))).otherwise(F.lit(0).cast("long"))))
    df = keep(df, "mix-members")
    by_source = {r.source: int(r.n) for r in df.groupBy("source").agg(F.sum("size").alias("n")).limit(MAX_SOURCES + 1).collect()}
    if len(by_source) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: merge rare ones first")
    words: dict[tuple[tuple, str | None], int] = {}
    supply: dict[tuple, int] = {}
    # a text's words count once for its pattern, taken from its first source
    once = F.when(~F.col("again") & F.col("source").eqNullSafe(F.get("pattern", F.lit(0))), F.col("size")).otherwise(0)
    for r in df.groupBy("pattern", "source").agg(F.sum("size").alias("n"), F.sum(once).alias("texts")).collect():
        p = tuple(r.pattern)
        words[p, r.source] = int(r.n)
        supply[p] = supply.get(p, 0) + int(r.texts)
    target = fair_targets(list(by_source.items()), weights, budget, passes)
    flow = min_cost_flow(supply, {s: round(t) for s, t in target.items()}, {k: passes * n for k, n in words.items()})
    rows = [(list(p), s, by_source[s], float(target[s]), flow.get((p, s), 0) // n if n else 0, flow.get((p, s), 0) % n if n else 0) for (p, s), n in words.items()]
    kind = df.schema["source"].dataType.simpleString()
    quota = spark.createDataFrame(rows, f"p array<{kind}>, s {kind}, source_size long, target double, full long, extra long")
    sent = F.broadcast if len(rows) <= SENT_UNITS else lambda d: d
    df = df.join(sent(quota), df.pattern.eqNullSafe(quota.p) & df.source.eqNullSafe(quota.s), "left").drop("p", "s")
    df = df.withColumn("unit", F.struct("pattern", "source"))
    return _select(df, sent).select(F.col("id").alias(id_col), "size", "source", "pattern", "source_size", "target", "taken")


def _select(df: DataFrame, sent: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``taken`` = full passes and, from the front of the seeded order, ``extra`` words more.

    Level 1 sums the sizes of _BUCKETS hash ranges a unit (pattern and source), level 2 those of
    the range in which ``extra`` runs out; only that second-level range is sorted.
    """
    df = df.withColumn("b1", F.shiftrightunsigned("h", 52).cast("int")).withColumn("b2", F.shiftrightunsigned("h", 40).bitwiseAND(F.lit(_BUCKETS - 1)).cast("int"))

    def border(rows: DataFrame, bucket: str, given: str, out: str) -> DataFrame:
        """The bucket where the running sum passes what is given, and the sum before it."""
        sums = rows.groupBy("unit", given, bucket).agg(F.sum("size").alias("s"))
        run = F.sum("s").over(W.partitionBy("unit").orderBy(bucket).rowsBetween(W.unboundedPreceding, -1))
        before = sums.withColumn("before", F.coalesce(run, F.lit(0)))
        cut = before.where((F.col("before") <= F.col(given)) & (F.col("before") + F.col("s") > F.col(given)))
        return cut.select(F.col("unit").alias("cut_unit"), F.col(bucket).alias(f"cut_{bucket}"), (F.col(given) - F.col("before")).alias(out))

    one = sent(border(df, "b1", "extra", "left1"))  # one row a unit
    df = df.join(one, df.unit.eqNullSafe(one.cut_unit), "left").drop("cut_unit")
    inner = df.where("b1 = cut_b1")
    two = sent(border(inner, "b2", "left1", "left2"))
    df = df.join(two, df.unit.eqNullSafe(two.cut_unit), "left").drop("cut_unit")
    order = W.partitionBy("unit").orderBy("h", "size", "id").rowsBetween(W.unboundedPreceding, -1)
    at = (F.col("b1") == F.col("cut_b1")) & (F.col("b2") == F.col("cut_b2"))
    last = df.where(at).withColumn("run", F.coalesce(F.sum("size").over(order), F.lit(0)))
    last = last.withColumn("more", F.greatest(F.lit(0), F.least("size", F.col("left2") - F.col("run"))))
    rest = df.where(~F.coalesce(at, F.lit(False))).withColumn("run", F.lit(0).cast("long"))
    front = (F.col("b1") < F.col("cut_b1")) | ((F.col("b1") == F.col("cut_b1")) & (F.col("b2") < F.col("cut_b2")))
    rest = rest.withColumn("more", F.when(front, F.col("size")).otherwise(0))
    both = last.unionByName(rest)
    return both.withColumn("taken", (F.coalesce(F.col("full"), F.lit(0)) * F.col("size") + F.col("more")).cast("long"))


def apply_mix(docs: DataFrame, plan: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The mixed documents: one row for each pass over a document, whole or its first words."""
    taken = plan.select(F.col(id_col).alias("__mix_id"), F.col("size").alias("__mix_size"), F.col("taken").alias("__mix_taken")).groupBy("__mix_id").agg(F.max("__mix_size").alias("__mix_size"), F.max("__mix_taken").alias("__mix_taken"))
    df = docs.join(taken, docs[id_col].eqNullSafe(taken["__mix_id"])).where("__mix_taken > 0")
    df = df.withColumn("__mix_pass", F.explode(F.sequence(F.lit(1), F.ceil(F.col("__mix_taken") / F.col("__mix_size")).cast("int"))))
    words = F.least(F.col("__mix_size"), F.col("__mix_taken") - (F.col("__mix_pass") - 1) * F.col("__mix_size"))
    # pieces that each start at a word; a blank beginning is a piece of its own
    pieces = F.split(F.col(text_col), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    blank = F.when(F.col(text_col).rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)
    front = F.array_join(F.slice(pieces, F.lit(1), words.cast("int") + blank), "")
    df = df.withColumn(text_col, F.when(words < F.col("__mix_size"), front).otherwise(F.col(text_col)))
    return df.select(*[F.col(c) for c in docs.columns])
