"""Jaccard self-join of word shingles, size-aware: heavy and light sets.

Equal sets are one class from the start, so a group of copies is one node.
Light sets (size up to a boundary) list the subsets of the fixed size that a
link needs: two of them link exactly if they share one, so a shared subset links
all its holders by a star, without pairs.  Heavy sets post their prefix, rarest
shingles first (Chaudhuri et al., 2006), and the inverted lists are scanned.
The boundary is where the two costs, over the sizes that the corpus has, add up
to the least (after Deng, Tao and Li, 2018).

Large groups of near copies are linked first by stars: classes that share a band
of minima (one-permutation hashing) with STAR others or more are verified against
the group's least class alone.  That joins most of a group by as many pairs as
it has members; it decides nothing by itself, since the lists find every link
that the stars miss.

Scanning a list never emits its pairs, and a list never compares classes that
are joined already: members stand in the order of their components, and meet
those of other components only.  Lists above LIST members are dealt by pairs of
blocks over many tasks.  Within a task, arrays compare parity
sketches, whose Hamming distance bounds the symmetric difference from below, and
sizes; each class then names only its few least partners above a cursor, from
other components.  Named pairs are verified on the whole sets, links merge
components, and the scan repeats until no class names anyone.  A pair is
skipped only when its sketch or size excludes it, or a chain of verified links
already joins it, so no link between components is lost.

The order of shingles puts frequent ones last.  Which are frequent is estimated
from counts inside tasks; any order gives the same result, so the estimate only
moves work.  A pair of 64-bit hashes of different shingles or sets may collide
with a chance of about n**2 / 2**65.

Defined results: null text and text without words have an empty set, linked with
nothing; fewer words than a shingle are one shingle; rows that share an id are
handled as one document each, and the component is the smallest id; a row
without an id has no component and links nothing; extra columns are ignored; an empty table gives an empty result.
Texts of any length are taken whole; bytes grow with a text's words.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BUCKET_BYTES, batch, components, join_hot, keep, mix64, partitions, runs

WORDS = 4
#: Bytes of a posting in a scan, and the buckets that a class's sketch is counted for, at most: both only size the buckets.
_ROW_BYTES, MOST_COPIES = 24, 1024
#: Buckets of a scan, at least: so many that a class of usual size has about one posting in each of its own, at any size of the corpus.
SCAN_BUCKETS = 256
#: Documents link when DEN * intersection >= NUM * union.
NUM, DEN = 85, 100
#: What a posting costs against a subset key: it may have to be compared and verified.
SCAN_COST = 8
MAX_LIGHT = 24
#: A shingle is frequent in more than one of so many documents; the list of them stays below a bound.
FREQUENT = 2000
MAX_FREQUENT = 2_000_000
#: Sketch bits for each element; the first scan folds sketches to a quarter of that.
SKETCH_BITS = 2
FOLD = 4
#: Partners that a class names in the first, second, ... scan.
NAMES = (1, 4, 16, 64)
#: Bands of a set's minima, minima in a band, and classes with a band in common that make a star.
BANDS, BAND, STAR = 6, 3, 16
#: Members of a list that one task compares, about.
LIST = 4096
FLUSH = 4 << 20
#: Pairs that one round of array work compares.
PAIRS = 1 << 20
_POSTING = np.dtype([("key", "<u8"), ("c", "<i8"), ("n", "<i4")])


def overlap(n: int, m: int, num: int = NUM, den: int = DEN) -> int:
    """The least intersection of linked sets of sizes n and m."""
    return -(-num * (n + m) // (num + den))


def prefix(n, num: int = NUM, den: int = DEN):
    """Shingles of which linked sets share at least one, in any common order."""
    return n - -(-num * n // den) + 1


def partner_sizes(n: int, num: int = NUM, den: int = DEN) -> range:
    return range(-(-num * n // den), den * n // num + 1)


def light_keys(n: int, limit: int, num: int, den: int) -> int:
    return sum(comb(n, overlap(n, m, num, den)) for m in partner_sizes(n, num, den) if m <= limit)


def choose_boundary(sizes: dict[int, int], num: int = NUM, den: int = DEN) -> int:
    """The boundary with the least cost; ``sizes``: how many classes have each size up to 2 * MAX_LIGHT."""

    def cost(b: int) -> int:
        light = sum(k * light_keys(n, b, num, den) for n, k in sizes.items() if n <= b)
        return light + SCAN_COST * sum(k * prefix(n, num, den) for n, k in sizes.items() if den * n >= num * (b + 1))

    return min(range(MAX_LIGHT + 1), key=lambda b: (cost(b), b))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # A-Z and ASCII blanks only
    if not found:
        return np.zeros(0, np.uint64)
    if len(found) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(found), seed=len(found))], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    n = len(h) - words + 1
    out = np.zeros(n, np.uint64)
    for k in range(words):
        out = mix64(out + h[k : k + n] + np.uint64(k + 1))
    return np.unique(out)


def class_id(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes(), seed=len(s)) - (1 << 63)


def sketch(s: np.ndarray) -> bytes:
    """Parity of the elements in each of a power of two of cells: equal elements cancel in the XOR of two sketches."""
    bits = max(128 * FOLD, 1 << (SKETCH_BITS * len(s) - 1).bit_length())
    odd = np.bincount((s >> np.uint64(20) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def bands(s: np.ndarray) -> list[int] | None:
    """Keys of the bands of a sorted set's minima; a range without an element takes the next element."""
    n = BANDS * BAND
    if len(s) <= MAX_LIGHT:
        return None
    edges = (np.arange(n, dtype=np.uint64) * np.uint64((1 << 64) // n)).astype(np.uint64)
    least = s[np.searchsorted(s, edges) % len(s)].reshape(BANDS, BAND)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(BAND):
        out = mix64(out + least[:, k])
    return out.view(np.int64).tolist()


def fold(raw: bytes, times: int = FOLD) -> bytes:
    """A sketch with ``times`` as few cells: halves are XORed."""
    x = np.frombuffer(raw, np.uint64)
    while times > 1:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        times //= 2
    return x.tobytes()


def _rows(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[int, np.ndarray]]:
    for b in batches:
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            yield doc_id, shingles(text.as_py(), words)


def profiles(docs: DataFrame, words: int) -> DataFrame:
    """(kind, id, n, c, sketch, bands): kind 0 documents with set size and class, kind 1 shingles and their count in a task.

    A class's sketch and bands stand once in a task at least.
    """
    schema = pa.schema([("kind", pa.int32()), ("id", pa.int64()), ("n", pa.int64()), ("c", pa.int64()), ("sketch", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        out: list[tuple[int, int, int]] = []
        marks: list[tuple[bytes | None, list[int] | None]] = []
        size, seen = 0, set()

        def flush() -> Iterator[pa.RecordBatch]:
            token, n = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)
            often = n >= 2
            token, n = token[often].view(np.int64), n[often].astype(np.int64)
            ids, ns, cs = (np.array(x, np.int64) for x in (zip(*out, strict=True) if out else ([], [], [])))
            yield batch(schema, kind=pa.array(np.repeat(np.int32([0, 1]), [len(ids), len(token)])), id=pa.array(np.concatenate([ids, token])), n=pa.array(np.concatenate([ns, n])), c=pa.array(np.concatenate([cs, np.zeros(len(token), np.int64)])), sketch=[m[0] for m in marks] + [None] * len(token), bands=[m[1] for m in marks] + [None] * len(token))

        for doc_id, s in _rows(batches, words):
            c = class_id(s)
            out.append((doc_id, len(s), c))
            marks.append((sketch(s), bands(s)) if c not in seen and len(s) else (None, None))
            if c not in seen:
                seen.add(c)
                held.append(s)
                size += len(s)
            if size >= FLUSH or len(out) >= 1 << 16:
                yield from flush()
                held, out, marks, size, seen = [], [], [], 0, set()
        if out:
            yield from flush()

    return docs.mapInArrow(work, "kind int, id long, n long, c long, sketch binary, bands array<long>")


def _light(s: np.ndarray, limit: int, num: int, den: int) -> tuple[list[int], list[int]]:
    """Keys of the fixed-size subsets that a link with a light partner of each size needs.

    The second list has the set's size, negative where the partner's is the same.
    """
    n, keys, marks = len(s), [], []
    values = [int(x) for x in mix64(s)]
    for m in partner_sizes(n, num, den):
        size = overlap(n, m, num, den)
        if m <= limit and size <= min(n, m):
            tag = (min(n, m) * 1000 + max(n, m)) * 1000 + size
            subsets = [(sum(sub) + tag * 0x9E3779B97F4A7C15) & (1 << 64) - 1 for sub in combinations(values, size)]
            keys += subsets
            marks += [-n if m == n else n] * len(subsets)
    return keys, marks


def _post(docs: DataFrame, words: int, limit: int, frequent, buckets: int, num: int, den: int) -> DataFrame:
    """(bucket, kind, blob): kind 1 prefix postings, kind 2 subset keys of light sets."""
    schema = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = frequent.value
        held: dict[int, list[np.ndarray]] = {1: [], 2: []}
        size, seen = 0, set()

        def flush() -> Iterator[pa.RecordBatch]:
            rows = []
            for kind, parts in held.items():
                if parts:
                    p = np.concatenate(parts)
                    to = (mix64(p["key"]) % np.uint64(buckets)).astype(np.int64)
                    order = np.argsort(to, kind="stable")
                    p, to = p[order], to[order]
                    rows += [(int(to[i]), kind, p[i : i + k].tobytes()) for i, k in zip(*runs(to), strict=True)]
            yield batch(schema, bucket=[r[0] for r in rows], kind=[r[1] for r in rows], blob=[r[2] for r in rows])

        def hold(kind: int, keys, c: int, n) -> int:
            p = np.zeros(len(keys), _POSTING)
            p["key"], p["c"], p["n"] = keys, c, n
            held[kind].append(p)
            return len(keys)

        for _, s in _rows(batches, words):
            n, c = len(s), class_id(s)
            if not n or c in seen:
                continue
            seen.add(c)
            if n <= limit:
                keys, marks = _light(s, limit, num, den)
                size += hold(2, np.array(keys, np.uint64), c, marks)
            if den * n >= num * (limit + 1):
                if len(often):
                    late = often[np.minimum(np.searchsorted(often, s), len(often) - 1)] == s
                    s = np.concatenate([s[~late], s[late]])
                size += hold(1, s[: prefix(n, num, den)], c, n)
            if size >= FLUSH // 2:
                yield from flush()
                held, size, seen = {1: [], 2: []}, 0, set()
        if size:
            yield from flush()

    return docs.mapInArrow(work, "bucket int, kind int, blob binary")


def _lists(posted: DataFrame) -> DataFrame:
    """(kind, key, c, n): kind 1 the postings of lists with two classes or more, kind 2 links (key, c) of light sets."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for kind in (1, 2):
            blobs = pdf.loc[pdf["kind"] == kind, "blob"]
            if not len(blobs):
                continue
            p = np.concatenate([np.frombuffer(b, _POSTING) for b in blobs])
            p = p[np.lexsort((p["c"], p["key"]))]
            new = np.ones(len(p), bool)
            new[1:] = (p["key"][1:] != p["key"][:-1]) | (p["c"][1:] != p["c"][:-1])
            p = p[new]
            at, size = runs(p["key"])
            if kind == 1:
                p = p[np.repeat(size > 1, size)]
                out.append(pd.DataFrame({"kind": np.full(len(p), 1, np.int32), "key": p["key"].view(np.int64), "c": p["c"], "n": p["n"]}))
            else:
                # holders of two sizes all link across, and of one size only if that is what the key asks for
                low, high = np.minimum.reduceat(p["n"], at), np.maximum.reduceat(p["n"], at)
                linked = np.repeat((size > 1) & ((low != high) | (low < 0)), size)
                lead = np.repeat(p["c"][at], size)[linked]
                p = p[linked]
                out.append(pd.DataFrame({"kind": np.full(len(p), 2, np.int32), "key": lead, "c": p["c"], "n": p["n"]}))
        if not out:
            return pd.DataFrame({"kind": np.zeros(0, np.int32), "key": np.zeros(0, np.int64), "c": np.zeros(0, np.int64), "n": np.zeros(0, np.int32)})
        return pd.concat(out)

    return posted.groupBy("bucket").applyInPandas(work, "kind int, key long, c long, n int")


class _Scan:
    """Array comparison of one bucket's lists (key, c) between the classes (c, n, comp, cursor, sketch) that it has."""

    def __init__(self, lists: pd.DataFrame, classes: pd.DataFrame, names: int, num: int, den: int):
        self.num, self.den, self.names = num, den, names
        pdf = classes
        ids, first = np.unique(pdf["c"].to_numpy(np.int64), return_index=True)
        self.ids = ids
        self.n = pdf["n"].to_numpy(np.int64)[first]
        self.comp = pdf["comp"].to_numpy(np.int64)[first]
        self.cursor = pdf["cursor"].to_numpy(np.int64)[first]
        raw = pdf["sketch"].iloc[first].tolist()
        self.words = np.array([len(r) // 8 for r in raw], np.int64)
        self.begin = np.cumsum(self.words) - self.words
        self.sketch = np.frombuffer(b"".join(raw), np.uint64)
        lists = lists[np.isin(lists["c"].to_numpy(np.int64), ids)]
        key = lists["key"].to_numpy(np.int64)
        member = np.searchsorted(ids, lists["c"].to_numpy(np.int64))
        order = np.lexsort((member, self.comp[member], key))
        self.member = member[order]
        self.at, self.size = runs(key[order])
        # where a member's component starts in its list
        comp, key = self.comp[self.member], key[order]
        new = np.ones(len(order), bool)
        new[1:] = (key[1:] != key[:-1]) | (comp[1:] != comp[:-1])
        begin = np.flatnonzero(new)
        self.own = begin[np.cumsum(new) - 1] if len(order) else np.zeros(0, np.int64)

    def blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index pairs (larger, smaller) of each list's members in different components, about PAIRS at a time."""
        # a member meets the components before its own
        base = np.repeat(self.at, self.size)
        before = self.own - base
        ends = np.cumsum(before)
        lo = 0
        while lo < len(before):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, side="right")))
            n = before[lo:hi]
            x = np.repeat(np.arange(lo, hi), n)
            y = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(base[lo:hi], n)
            x, y = self.member[x], self.member[y]
            yield np.maximum(x, y), np.minimum(x, y)
            lo = hi

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """A lower bound on the symmetric difference of each pair."""
        out = np.zeros(len(x), np.int64)
        sizes = self.words[x] << 32 | self.words[y]
        for both in np.unique(sizes):
            wx, wy = int(both) >> 32, int(both) & 0xFFFFFFFF
            w = min(wx, wy)
            mine = np.flatnonzero(sizes == both)
            step = max(1, PAIRS * 8 // max(wx, wy))
            for lo in range(0, len(mine), step):
                at = mine[lo : lo + step]
                total = np.zeros((len(at), w), np.uint64)
                for side, width in ((x, wx), (y, wy)):
                    for k in range(0, width, w):  # the longer sketch is folded
                        total ^= self.sketch[self.begin[side[at]][:, None] + np.arange(k, k + w)]
                out[at] = np.bitwise_count(total).sum(1)
        return out

    def survivors(self) -> Iterator[np.ndarray]:
        """Codes larger * m + smaller of the pairs that neither size nor sketch nor component excludes."""
        m = len(self.ids)
        for x, y in self.blocks():
            ok = self.ids[y] > self.cursor[x]
            small, large = np.minimum(self.n[x], self.n[y]), np.maximum(self.n[x], self.n[y])
            ok &= self.den * small >= self.num * large
            key = np.unique(x[ok] * m + y[ok])
            both = self.n[key // m] + self.n[key % m]
            need = -(-self.num * both // (self.num + self.den))
            yield key[self.apart(key // m, key % m) <= both - 2 * need]

    def pairs(self) -> np.ndarray:
        """(larger, smaller) ids: the ``names`` least partners of each class that may link."""
        best, m = np.zeros(0, np.int64), len(self.ids)
        for key in self.survivors():
            if len(key):
                best = np.unique(np.concatenate([best, key]))
                at, n = runs(best // m)
                best = best[np.arange(len(best)) - np.repeat(at, n) < self.names]
        return self.ids[np.stack([best // m, best % m], 1)]

    def touched(self) -> np.ndarray:
        """Ids of the classes that may link with any other."""
        hit, m = np.zeros(len(self.ids), bool), len(self.ids)
        for key in self.survivors():
            hit[key // m] = hit[key % m] = True
        return self.ids[hit]


def _split(lists: DataFrame) -> DataFrame:
    """Lists above LIST members as lists of two of their blocks each, so that any two members meet in one."""
    parts = F.ceil(F.col("m") * 2 / F.lit(LIST)).cast("int")
    long = lists.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > LIST).withColumn("parts", parts)
    long = keep(long, "long-lists")
    if long.isEmpty():
        return lists
    marked = join_hot(lists, long, ["key"], "m", lists.count(), "left")
    mine = F.pmod(F.xxhash64("c"), "parts").cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: p != mine)
    pairs = F.transform(others, lambda p: F.xxhash64("key", F.least(p, mine), F.greatest(p, mine)))
    return marked.select(F.explode(F.when(F.col("parts").isNull(), F.array("key")).otherwise(pairs)).alias("key"), "c", "n")


def _open(lists: DataFrame, state: DataFrame) -> DataFrame:
    """The lists whose members are not all joined."""
    ends = lists.join(state.select("c", "comp"), "c").groupBy("key").agg(F.min("comp").alias("p"), F.max("comp").alias("q"))
    return lists.join(ends.where("p <> q").select("key"), "key")


def _stars(docs: DataFrame, classes: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(x, y): verified links of classes to the least class of a large group with a band in common."""
    keys = classes.where("bands IS NOT NULL").select("c", F.explode("bands").alias("key"))
    groups = keys.groupBy("key").agg(F.count("*").alias("m"), F.min("c").alias("y")).where(F.col("m") >= STAR)
    groups = keep(groups, "bands")
    found = join_hot(keys, groups, ["key"], "m", classes.count() * BANDS).where("c <> y")
    pairs = keep(found.select(F.col("c").alias("x"), "y").distinct(), "stars")
    ids = pairs.select(F.col("x").alias("c")).union(pairs.select("y")).distinct()
    wanted = classes.join(ids, "c", "left_semi").select(F.col("first").alias("id"), "c")
    return keep(_verified(pairs, _sets(docs, wanted, words), num, den), "star-links")


def _buckets(lists: DataFrame, state: DataFrame, least: int) -> int:
    """Buckets of about BUCKET_BYTES: postings, and a class's sketch once a bucket that has the class."""
    per = lists.groupBy("c").agg(F.count("*").alias("m")).join(state.select("c", F.length("sketch").alias("size")), "c")
    size = F.col("m") * _ROW_BYTES + F.least("m", F.lit(MOST_COPIES)) * F.col("size")
    return max(least, int((per.agg(F.sum(size)).first()[0] or 0) // BUCKET_BYTES) + 1)


def _scanned(lists: DataFrame, state: DataFrame, buckets: int, work, schema: str) -> DataFrame:
    """``work`` on each bucket's lists and classes.

    A class goes to each of its buckets once, however many of its postings are there:
    bytes grow with a text, not with its square.
    """
    dealt = lists.select(F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int").alias("bucket"), "key", "c", "n")
    places = dealt.groupBy("c").agg(F.min("n").alias("n"), F.collect_set("bucket").alias("buckets"))
    classes = state.join(places, "c").select(F.explode("buckets").alias("bucket"), "c", "n", "comp", "cursor", "sketch")
    rows = dealt.select(F.col("bucket").alias("at"), "key", "c")
    return rows.groupBy("at").cogroup(classes.groupBy("bucket")).applyInPandas(work, schema)


def _touched(lists: DataFrame, state: DataFrame, buckets: int, num: int, den: int) -> DataFrame:
    """(c) of the classes that a first scan with folded sketches cannot exclude."""

    def work(rows: pd.DataFrame, classes: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"c": _Scan(rows, classes, 0, num, den).touched()})

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("c", pa.int64()), ("comp", pa.int64()), ("cursor", pa.int64()), ("sketch", pa.binary())])
        for b in batches:
            yield batch(schema, c=b.column(0), comp=b.column(1), cursor=b.column(2), sketch=[fold(r.as_py()) for r in b.column(3)])

    small = state.select("c", "comp", "cursor", "sketch").mapInArrow(folded, "c long, comp long, cursor long, sketch binary")
    return _scanned(lists, small, buckets, work, "c long").distinct()


def _named(lists: DataFrame, state: DataFrame, buckets: int, names: int, num: int, den: int) -> DataFrame:
    def work(rows: pd.DataFrame, classes: pd.DataFrame) -> pd.DataFrame:
        p = _Scan(rows, classes, names, num, den).pairs()
        return pd.DataFrame({"x": p[:, 0], "y": p[:, 1]})

    found = _scanned(lists, state, buckets, work, "x long, y long").distinct()
    rank = F.row_number().over(W.partitionBy("x").orderBy("y"))
    return found.withColumn("rank", rank).where(F.col("rank") <= names).select("x", "y")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose whole sets link."""
    schema = pa.schema([("x", pa.int64()), ("y", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for s, t in zip(b.column("sx"), b.column("sy"), strict=True):
                s, t = np.frombuffer(s.as_py(), np.uint64), np.frombuffer(t.as_py(), np.uint64)
                at = np.minimum(np.searchsorted(t, s), len(t) - 1)
                same = int((t[at] == s).sum())
                good.append(den * same >= num * (len(s) + len(t) - same))
            yield b.select(["x", "y"]).filter(pa.array(good, pa.bool_())).cast(schema)

    # only the sets that are named move
    ids = pairs.select(F.col("x").alias("c")).union(pairs.select("y")).distinct()
    needed = keep(sets.join(ids, "c", "left_semi"), "named-sets")
    sx = needed.select(F.col("c").alias("x"), F.col("s").alias("sx"))
    sy = needed.select(F.col("c").alias("y"), F.col("s").alias("sy"))
    return pairs.join(sx, "x").join(sy, "y").select("x", "y", "sx", "sy").mapInArrow(work, "x long, y long")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """(id, n_shingles, component_id), one row for each input row."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    nameless = profiles(docs.where("id IS NULL").select(F.lit(0).cast("long").alias("id"), "text"), words).where("kind = 0")
    docs = docs.where("id IS NOT NULL")
    both = keep(profiles(docs, words), "profiles")
    prof = both.where("kind = 0").select("id", "n", "c", "sketch", "bands")
    n_docs = prof.count()
    often = both.where("kind = 1").groupBy("id").agg(F.sum("n").alias("df")).where(F.col("df") >= max(8, n_docs // FREQUENT))
    often = often.orderBy(F.col("df").desc(), "id").limit(MAX_FREQUENT).select("id").toArrow()  # MAX_FREQUENT at most
    frequent = spark.sparkContext.broadcast(np.sort(often.column("id").to_numpy().view(np.uint64)))
    classes = keep(prof.where("n > 0").groupBy("c").agg(F.min("id").alias("first"), F.min("n").alias("n"), F.max("sketch").alias("sketch"), F.max("bands").alias("bands")), "classes")
    sizes = {r.n: r.k for r in classes.where(F.col("n") <= 2 * MAX_LIGHT).groupBy("n").agg(F.count("*").alias("k")).collect()}
    limit = choose_boundary(sizes, num, den)
    total = classes.agg(F.sum(F.col("n"))).first()[0] or 0
    buckets = max(partitions(spark), int(total * (den - num) / den * _POSTING.itemsize / BUCKET_BYTES) + 1)
    lists = keep(_lists(_post(docs, words, limit, frequent, buckets, num, den)), "lists")
    links = lists.where("kind = 2").select(F.col("key").alias("x"), F.col("c").alias("y"))
    lists = _split(lists.where("kind = 1").select("key", "c", "n"))
    stars = _stars(docs, classes, words, num, den)
    links = links.unionByName(stars)
    labels = keep(components(links, "x", "y").select("node", F.col("component").alias("comp")), "labels")
    start = classes.select("c", "sketch").join(lists.select("c").distinct(), "c").join(labels.withColumnRenamed("node", "c"), "c", "left")
    state = start.select("c", "sketch", F.coalesce("comp", "c").alias("comp"), F.lit(-(1 << 63)).cast("long").alias("cursor"))
    if not stars.isEmpty():
        state = keep(state, "scan0")
        lists = keep(_open(lists, state), "lists")
    touched = keep(_touched(lists, state, max(buckets, SCAN_BUCKETS), num, den), "touched")
    state = keep(state.join(touched, "c", "left_semi"), "scan0")
    lists = keep(lists.join(touched, "c", "left_semi").select("key", "c", "n"), "lists")
    sets = keep(_sets(docs, classes.join(touched, "c", "left_semi").select(F.col("first").alias("id"), "c"), words), "sets")
    scan_buckets = _buckets(lists, state, max(partitions(spark), SCAN_BUCKETS))
    for turn in range(200):
        names = NAMES[turn] if turn < len(NAMES) else NAMES[-1] * 4 ** min(turn - len(NAMES) + 1, 6)
        named = keep(_named(lists, state, scan_buckets, names, num, den), "named")
        if named.isEmpty():
            break
        good = keep(_verified(named, sets, num, den), "verified")
        comp = state.select("c", "comp")
        ends = good.join(comp.withColumnsRenamed({"c": "x", "comp": "a"}), "x").join(comp.withColumnsRenamed({"c": "y", "comp": "b"}), "y")
        merged = keep(components(ends).withColumnsRenamed({"node": "comp", "component": "to"}), "merged")
        cursor = named.groupBy(F.col("x").alias("c")).agg(F.max("y").alias("at"))
        state = state.join(merged, "comp", "left").join(cursor, "c", "left")
        state = keep(state.select("c", "sketch", F.coalesce("to", "comp").alias("comp"), F.greatest("cursor", "at").alias("cursor")), "scan")
        # light sets outside the lists follow their component
        labels = keep(labels.join(merged, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), "labels")
        # lists whose members are all joined have nothing more to say
        lists = keep(_open(lists, state), "lists")
    else:
        raise RuntimeError("the scans did not settle")
    scanned = state.select("c", "comp")
    # light sets that no scan had to touch keep the label of their subsets
    light = labels.withColumnRenamed("node", "c").join(scanned, "c", "left_anti")
    nodes = classes.join(scanned.unionByName(light), "c").select("c", "comp", "first")
    root = nodes.groupBy("comp").agg(F.min("first").alias("root"))
    nodes = nodes.join(root, "comp").select("c", "root")
    final = classes.join(nodes, "c", "left").select("c", F.coalesce("root", "first").alias("root"))
    out = prof.join(final, "c", "left")
    out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("root")).alias("component_id"))
    none = F.lit(None).cast("long")
    return out.unionByName(nameless.select(none.alias(id_col), F.col("n").alias("n_shingles"), none.alias("component_id")))


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(c, s): the whole set of each wanted class, from its first document."""
    schema = pa.schema([("c", pa.int64()), ("s", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c, sets = [], []
            for want, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                s = shingles(text.as_py(), words)
                if class_id(s) == want:  # another row of the same id may hold another text
                    c.append(want)
                    sets.append(s.tobytes())
            yield batch(schema, c=c, s=sets)

    found = docs.join(wanted.hint("shuffle_hash"), "id").select("c", "text").mapInArrow(work, "c long, s binary")
    return found.dropDuplicates(["c"])
