"""Removal of repeated byte strings by a hash-compared suffix sort.

A byte goes if a ``WINDOW``-byte string that covers it also starts earlier in the
corpus (smaller id, or earlier in the same document).  Sorting every suffix of a
large corpus would move many times its size, so only anchors are sorted:

1. Prefix polynomial hashes (mod 2**64, random byte values) give every 32-byte
   string's hash.  A position is an anchor if its hash is the least among the
   69 that some window holds.  The choice depends on a window's bytes alone, so
   equal windows have equal anchors, and every window has one.
2. Anchors are dealt by hash; where hash and the hash of all bytes that the
   anchor's windows can cover agree, all but the earliest are repeats.  Tasks
   settle their own repeats before the exchange, so a passage in a third of all
   documents sends one row a task.
3. Anchors whose hash repeats with different surroundings fetch their bytes and
   are suffix-sorted: a mergesort whose comparisons find the common extension by
   binary search over prefix hashes, to the right and, mirrored, to the left.
   Neighbours' extensions are verified on the bytes.  Runs of the two sorted
   orders tell for each of the 69 windows which occurrence is first.

All different surroundings of one anchor are sorted in one task, about 1.7 KB
each: a line in very many documents, with other text around it each time, bounds
the corpus that this operator can take.

Defined results: null text counts as empty; matches never cross documents; rows
that share an id never make each other's equal positions repeats (only strictly
earlier starts count), and such a row loses what any row of its id with the same
text would; rows without an id take no part and keep every byte; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BUCKET_BYTES, batch, keep, mix64, partitions, runs

WINDOW = 100
GRAM = 32
#: Bytes that one round of array work handles, and anchors that a task holds before it sends them.
CHUNK = 1 << 20
FLUSH = 1 << 20
_MULT = 0x9E3779B97F4A7C15 | 1
_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)
_ANCHOR = np.dtype([("k", "<u8"), ("c", "<u8"), ("doc", "<i8"), ("pos", "<u4"), ("left", "u1"), ("right", "u1")])


@lru_cache(maxsize=2)
def _byte_values(which: int) -> np.ndarray:
    return mix64(np.arange(256, dtype=np.uint64) + np.uint64((which + 1) << 32)) | np.uint64(1)


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse mod 2**64."""
    with np.errstate(over="ignore"):
        up = np.full(n, _MULT, np.uint64)
        up[:1] = 1
        down = np.full(n, pow(_MULT, -1, 1 << 64), np.uint64)
        down[:1] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


class PrefixHash:
    """Hashes of all substrings of a byte array, from prefix sums."""

    def __init__(self, data: np.ndarray, which: int):
        size = 1 << max(12, int(len(data)).bit_length())
        up, self.down = _powers(size)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_byte_values(which)[data] * up[: len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return (self.sums[k:] - self.sums[:n]) * self.down[:n]


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over x[i : i + width], by doubling."""
    have = 1
    while have * 2 <= width:
        x = pick(x[:-have], x[have:])
        have *= 2
    return pick(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def anchors(data: np.ndarray, starts: np.ndarray, ids: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """Anchor records of documents that stand one after the other in ``data``."""
    n = len(data)
    lengths = np.diff(np.append(starts, n))
    if n < window or not (lengths >= window).any():
        return np.zeros(0, _ANCHOR)
    reach = window - gram + 1
    ends = np.repeat(starts + lengths, lengths)
    hashes = mix64(PrefixHash(data, 0).grams(gram))
    at = np.arange(n)
    hashes[at[: len(hashes)] + gram > ends[: len(hashes)]] = _MAX
    least = _slide(hashes, reach, np.minimum)
    least[at[: len(least)] + window > ends[: len(least)]] = 0  # not a window
    # p is an anchor if some window that holds it has it as its least hash
    pad = np.zeros(reach - 1, np.uint64)
    most = _slide(np.concatenate([pad, least, pad]), reach, np.maximum)
    pos = np.flatnonzero((most == hashes) & (hashes != _MAX) & (hashes != 0))
    doc = np.searchsorted(starts, pos, side="right") - 1
    begin, stop = starts[doc], starts[doc] + lengths[doc]
    left = np.minimum(pos - begin, reach - 1)
    right = np.minimum(stop - pos, window)
    around = PrefixHash(data, 1)(pos - left, pos + right)
    out = np.zeros(len(pos), _ANCHOR)
    out["k"] = hashes[pos]
    out["c"] = mix64(around + mix64((left * 256 + right).astype(np.uint64)))
    out["doc"], out["pos"], out["left"], out["right"] = ids[doc], pos - begin, left, right
    return out


def _settle(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The earliest anchor of each (hash, surroundings), and the others."""
    a = a[np.lexsort((a["pos"], a["doc"], a["c"], a["k"]))]
    first = np.ones(len(a), bool)
    same = (a["k"][1:] == a["k"][:-1]) & (a["c"][1:] == a["c"][:-1])
    first[1:] = ~same
    # equal positions of rows that share an id are no repeats of each other: they stay with the first
    lead = np.flatnonzero(first)[np.cumsum(first) - 1] if len(a) else np.zeros(0, int)
    twin = (a["doc"] == a["doc"][lead]) & (a["pos"] == a["pos"][lead])
    return a[first], a[~first & ~twin]


def merge_intervals(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The unions of overlapping or touching intervals of each document."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    new_doc = np.concatenate([[True], doc[1:] != doc[:-1]])
    # running maximum of the ends within a document: shift documents apart first
    span = int(end.max()) + 1
    shift = (np.cumsum(new_doc) - 1) * span
    top = np.maximum.accumulate(end + shift)
    new = np.concatenate([[True], start[1:] + shift[1:] > top[:-1]]) | new_doc
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], start[first], top[last] - shift[first]


def _covers(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    pos = a["pos"].astype(np.int64)
    return merge_intervals(a["doc"], pos - a["left"], pos + a["right"])


_ROWS = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])


def _send_anchors(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, kind, blob): kind 0 are anchors, 1 intervals that a task could settle itself."""

    def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        first, rest = _settle(np.concatenate(held))
        to = (first["k"] >> np.uint64(40)).astype(np.int64) % buckets
        order = np.argsort(to, kind="stable")
        first, to = first[order], to[order]
        at, n = runs(to)
        rows = [(int(to[i]), 0, first[i : i + k].tobytes()) for i, k in zip(at, n, strict=True)]
        doc, start, end = _covers(rest)
        spread = doc % buckets
        for b in np.unique(spread):
            mine = spread == b
            rows.append((int(b), 1, np.stack([doc[mine], start[mine], end[mine]]).astype("<i8").tobytes()))
        yield batch(_ROWS, bucket=[r[0] for r in rows], kind=[r[1] for r in rows], blob=[r[2] for r in rows])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        count = 0
        for ids, raw in _groups(batches):
            starts = np.concatenate([[0], np.cumsum([len(r) for r in raw])[:-1]]).astype(np.int64)
            held.append(anchors(np.frombuffer(b"".join(raw), np.uint8), starts, np.array(ids, np.int64)))
            count += len(held[-1])
            if count >= FLUSH:
                yield from flush(held)
                held, count = [], 0
        if count:
            yield from flush(held)

    return docs.mapInArrow(work, "bucket int, kind int, blob binary")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Ids and UTF-8 texts in groups of about CHUNK bytes; short texts cannot match and are skipped."""
    ids, raw, size = [], [], 0
    for b in batches:
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
            data = text.as_py() or b""
            if doc_id is None or len(data) < WINDOW:
                continue
            ids.append(doc_id)
            raw.append(data)
            size += len(data)
            if size >= CHUNK:
                yield ids, raw
                ids, raw, size = [], [], 0
    if ids:
        yield ids, raw


#: kind 0: bytes [a, b) of a document go; kind 1: the anchor at a, in bucket b, is to be sorted.
_FOUND = "kind int, doc_id long, a long, b long, k long"


def _match(sent: DataFrame, buckets: int) -> DataFrame:
    def work(key, pdf: pd.DataFrame) -> pd.DataFrame:
        blobs = pdf.loc[pdf["kind"] == 0, "blob"]
        done = [np.frombuffer(b, "<i8").reshape(3, -1) for b in pdf.loc[pdf["kind"] == 1, "blob"]]
        first, rest = _settle(np.concatenate([np.frombuffer(b, _ANCHOR) for b in blobs]) if len(blobs) else np.zeros(0, _ANCHOR))
        at, n = runs(first["k"])
        many = first[np.repeat(n > 1, n)]
        cover = np.stack(_covers(rest)) if len(rest) else np.zeros((3, 0), np.int64)
        doc, start, end = merge_intervals(*np.concatenate([*done, cover], axis=1).astype(np.int64))
        zero = np.zeros(len(doc), np.int64)
        return pd.DataFrame({
            "kind": np.repeat(np.int32([0, 1]), [len(doc), len(many)]),
            "doc_id": np.concatenate([doc, many["doc"]]),
            "a": np.concatenate([start, many["pos"].astype(np.int64)]),
            "b": np.concatenate([end, np.full(len(many), int(key[0]), np.int64)]),
            "k": np.concatenate([zero, many["k"].view(np.int64)]),
        })

    return sent.groupBy("bucket").applyInPandas(work, _FOUND)


# --- suffix sort of anchors with their bytes ---------------------------------


class HashSuffixes:
    """Rows of symbols with prefix hashes: common extensions by binary search."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        m, n = rows.shape
        self.hash = np.zeros((m, n + 1), np.uint64)
        mult = np.uint64(_MULT)
        values = mix64(np.arange(512, dtype=np.uint64) + np.uint64(7 << 40))
        for j in range(n):
            self.hash[:, j + 1] = self.hash[:, j] * mult + values[rows[:, j]]

    def lcp(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        lo, hi = np.zeros(len(x), np.int64), np.full(len(x), self.rows.shape[1], np.int64)
        for _ in range(self.rows.shape[1].bit_length()):
            mid = (lo + hi + 1) // 2
            same = self.hash[x, mid] == self.hash[y, mid]
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def less(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        depth = self.lcp(x, y)
        inside = np.minimum(depth, self.rows.shape[1] - 1)
        return (depth < self.rows.shape[1]) & (self.rows[x, inside] < self.rows[y, inside])

    def sort(self, group: np.ndarray) -> np.ndarray:
        """Mergesort of each group's rows; ``group`` is sorted.  All merges of a level run together."""
        order = np.arange(len(group))
        begin, size = runs(group)
        lo, local = np.repeat(begin, size), np.arange(len(group)) - np.repeat(begin, size)
        n = np.repeat(size, size)
        width = 1
        while len(size) and width < size.max():
            live = np.flatnonzero(n > width)
            run = local[live] // width
            mine = run * width
            other = np.where(run % 2 == 0, mine + width, mine - width)
            stop = np.minimum(other + width, n[live])
            has = other < n[live]
            a, b = np.where(has, other, 0), np.where(has, stop, 0)
            item, base = order[live], lo[live]
            right = run % 2 == 1
            for _ in range(int(width).bit_length() + 1):
                open_ = a < b
                mid = (a + b) // 2
                rival = order[np.where(open_, base + mid, live)]
                # a left item comes before its equals, a right one after them
                before = np.where(right, ~self.less(item, rival), self.less(rival, item))
                a = np.where(open_ & before, mid + 1, a)
                b = np.where(open_ & ~before, mid, b)
            rank = np.where(has, a - other, 0)
            target = base + np.where(right, other, mine) + (local[live] - mine) + rank
            merged = order.copy()
            merged[target] = item
            order = merged
            width *= 2
        return order

    def neighbours(self, order: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Common extension of each sorted row with the one before it, verified on the symbols."""
        out = np.zeros(len(order), np.int64)
        if len(order) > 1:
            x, y = order[1:], order[:-1]
            depth = self.lcp(x, y)
            # a hash collision would show as a difference inside the extension
            differ = self.rows[x] != self.rows[y]
            true = np.where(differ.any(1), differ.argmax(1), self.rows.shape[1])
            out[1:] = np.where(group[1:] == group[:-1], np.minimum(depth, true), -1)
        out[:1] = -1
        return out


def repeats(k: np.ndarray, doc: np.ndarray, pos: np.ndarray, left: np.ndarray, right: np.ndarray, ctx: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals that repeat an earlier anchor's bytes; ``ctx`` has the anchor at column window - gram."""
    reach = window - gram
    order = np.lexsort((pos, doc, k))
    k, doc, pos, left, right, ctx = k[order], doc[order], pos[order], left[order], right[order], ctx[order]
    begin, _ = runs(k)
    group = np.zeros(len(k), np.int64)
    group[begin[1:]] = 1
    group = np.cumsum(group)
    classes = {}
    for side, rows in (("R", ctx[:, reach:]), ("L", ctx[:, :reach][:, ::-1])):
        s = HashSuffixes(np.ascontiguousarray(rows))
        by = s.sort(group)
        classes[side] = by, s.neighbours(by, group)

    def class_at(side: str, depth: int) -> np.ndarray:
        by, near = classes[side]
        out = np.empty(len(by), np.int64)
        out[by] = np.cumsum(near < depth)
        return out

    dup = np.zeros((len(k), reach + 2), bool)  # columns 0 and reach+1.. close runs
    for a in range(reach + 1):
        ok = np.flatnonzero((left >= a) & (right >= window - a))
        if len(ok) < 2:
            continue
        key = class_at("R", window - a)[ok] << 32 | class_at("L", a)[ok]
        # rows of a group stand in order of (doc, pos): the first of a key is the earliest
        _, first, back = np.unique(key, return_index=True, return_inverse=True)
        lead = ok[first[back]]
        dup[ok, a] = (doc[ok] != doc[lead]) | (pos[ok] != pos[lead])
    edge = np.diff(np.concatenate([np.zeros((len(k), 1), np.int8), dup.view(np.int8)], axis=1), axis=1)
    row, lo = np.nonzero(edge == 1)
    row2, hi = np.nonzero(edge == -1)
    return merge_intervals(doc[row], pos[row] - (hi - 1), pos[row2] - lo + window)


def _fetch(docs: DataFrame, requests: DataFrame) -> DataFrame:
    """(bucket, blob): the requested anchors with the bytes around them."""
    width = 2 * WINDOW - GRAM
    record = np.dtype([("k", "<u8"), ("doc", "<i8"), ("pos", "<u4"), ("left", "u1"), ("right", "u1"), ("ctx", "<u2", (width,))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bucket", pa.int32()), ("blob", pa.binary())])
        reach = WINDOW - GRAM
        for b in batches:
            held: dict[int, list[bytes]] = {}
            for doc_id, text, wanted in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), b.column(2).to_pylist(), strict=True):
                data = np.frombuffer(text.as_py(), np.uint8)
                want = np.array([(w["a"], w["b"], w["k"]) for w in wanted], np.int64)
                want = want[want[:, 0] + GRAM <= len(data)]
                padded = np.full(len(data) + reach + WINDOW, 256, np.uint16)
                padded[reach : reach + len(data)] = data
                out = np.zeros(len(want), record)
                out["k"], out["doc"], out["pos"] = want[:, 2].view(np.uint64), doc_id, want[:, 0]
                out["left"], out["right"] = np.minimum(want[:, 0], reach), np.minimum(len(data) - want[:, 0], WINDOW)
                out["ctx"] = padded[want[:, 0][:, None] + np.arange(width)]
                for to in np.unique(want[:, 1]):
                    held.setdefault(int(to), []).append(out[want[:, 1] == to].tobytes())
            yield batch(schema, bucket=list(held), blob=[b"".join(x) for x in held.values()])

    asked = requests.groupBy("doc_id").agg(F.collect_list(F.struct("a", "b", "k")).alias("wanted"))
    joined = _join(docs, asked, "inner")
    sent = joined.select("doc_id", "text", "wanted").mapInArrow(work, "bucket int, blob binary")

    def sort(key, pdf: pd.DataFrame) -> pd.DataFrame:
        r = np.concatenate([np.frombuffer(b, record) for b in pdf["blob"]])
        doc, start, end = repeats(r["k"], r["doc"], r["pos"].astype(np.int64), r["left"].astype(np.int64), r["right"].astype(np.int64), r["ctx"])
        return pd.DataFrame({"doc_id": doc, "a": start, "b": end})

    return sent.groupBy("bucket").applyInPandas(sort, "doc_id long, a long, b long")


def _join(docs: DataFrame, side: DataFrame, how: str) -> DataFrame:
    """Texts with what belongs to them: a shuffle at every size, and no sort of texts."""
    return docs.join(side.hint("shuffle_hash"), "doc_id", how)


def find_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, a, b): bytes [a, b) of these documents are repeats; intervals may overlap."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    per_anchor = (WINDOW - GRAM + 2) / 2
    buckets = max(partitions(docs.sparkSession), int(total / per_anchor * _ANCHOR.itemsize / BUCKET_BYTES) + 1)
    found = keep(_match(_send_anchors(docs, buckets), buckets), "repeats")
    requests = found.where("kind = 1").select("doc_id", "a", "b", "k")
    return found.where("kind = 0").select("doc_id", "a", "b").unionByName(_fetch(docs, requests))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept): what is left of each document, as bytes."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    gone = keep(find_repeats(docs), "repeat-intervals")
    spans = gone.groupBy("doc_id").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    joined = _join(docs, spans, "left")
    schema = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")], ("kept", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, text, spans in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), b.column(2).to_pylist(), strict=True):
                data = text.as_py()
                if spans:
                    a = np.array([(0, s["a"], min(s["b"], len(data))) for s in spans if s["a"] < len(data)], np.int64).reshape(-1, 3)
                    _, start, end = merge_intervals(a[:, 0], a[:, 1], a[:, 2])
                    parts, at = [], 0
                    for lo, hi in zip(start.tolist(), end.tolist(), strict=True):
                        parts.append(data[at:lo])
                        at = hi
                    rows.append((doc_id, len(data), int((end - start).sum()), len(start), b"".join([*parts, data[at:]])))
                else:
                    rows.append((doc_id, len(data), 0, 0, data))
            yield batch(schema, **dict(zip(schema.names, map(list, zip(*rows, strict=True)), strict=True)) if rows else dict.fromkeys(schema.names, []))

    out = joined.select("doc_id", "text", "spans").mapInArrow(work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumnRenamed("doc_id", id_col)


def digest(kept: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return kept.select(id_col, "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


