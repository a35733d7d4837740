"""Reversible line dedup: sharded cuckoo filters over exact reference counts.

The state of a corpus (:class:`LineIndex`) is three written tables, all keyed by
a line key's 128-bit hash or the shard that it falls into:

* ``postings`` (h1, h2, doc_id, copy, spots): which document holds which key, and
  at which lines;
* ``counts`` (h1, h2, n_docs, last_doc): in how many documents each key is, and
  the largest of them, exactly;
* ``filters`` (shard, buckets, filter): a cuckoo filter of each shard's frequent
  keys, those in ``min_docs`` documents or more.

:func:`insert_documents` and :func:`delete_documents` change counts by the new
or leaving documents' own postings, and insert into or delete from the filters
only the keys whose count crosses ``min_docs``; a shard without such a key keeps
its filter's bytes.  So a deletion puts back every line that a document had
pushed out, without counting the corpus again.  A corpus is built by inserting
it into the empty index.

Postings meet the filter of their shard; only those that it reports go to the
exact table, which removes the filters' false positives.  There are as many shards as
the frequent keys ask for, so a filter has a bound, and a shard's postings are
dealt over as many slices as its rows need, so neither a hot key nor a large
corpus fills a task, and no table of filters is sent to all tasks.

Defined results: null or empty text is one empty line; rows with the same id
are one document for the counts, and each row loses its own lines; a line is
kept in the largest id that holds it, wherever it stands there; rows without an
id count as one document and lose nothing; extra columns
are ignored; an empty table gives an empty result.  Inserting an id that the
index has already, in part or whole, is an error of the caller; deleting an
unknown id changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, keep, mix64, runs

MIN_CHARS = 40
MIN_DOCS = 5
SLOTS = 4
#: Shards of the key space, at least, and the frequent keys that a shard is made for: a filter of
#: twice as many, the most before the index is dealt over more shards, has 256 KB.
SHARDS, SHARD_KEYS = 256, 1 << 15
#: Shards up to which their slices are sent to every task; more are joined by a shuffle.
SENT_SHARDS = 1 << 16
#: Postings that meet a filter in one task, about.
SLICE_ROWS = 1 << 18
_BLANK = b" \t\n\x0b\x0c\r"

POSTINGS = "h1 long, h2 long, doc_id long, copy int, spots array<int>"


def line_keys(text: str | None, min_chars: int = MIN_CHARS) -> dict[bytes, list[int]]:
    """128-bit hash of each long line key of a text, with the lines that have it."""
    found: dict[bytes, list[int]] = {}
    for i, line in enumerate((text or "").encode("utf-8", "surrogatepass").split(b"\n")):
        if len(line) < min_chars:
            continue
        key = line.strip(_BLANK).lower()  # bytes.lower() changes A-Z only
        n = len(key)
        if n >= min_chars and (n >= 4 * min_chars or len(key.decode("utf-8", "surrogatepass")) >= min_chars):
            found.setdefault(xxhash.xxh3_128_digest(key), []).append(i)
    return found


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """One row for each document and distinct key; ``spots`` are its line numbers."""
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("copy", pa.int32()), ("spots", pa.list_(pa.int32()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, copies, keys, spots = [], [], [], []
            for doc_id, copy, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                for key, where in line_keys(text.as_py(), min_chars).items():
                    ids.append(doc_id)
                    copies.append(copy)
                    keys.append(key)
                    spots.append(where)
            h = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            yield batch(schema, h1=pa.array(h[:, 0]), h2=pa.array(h[:, 1]), doc_id=ids, copy=copies, spots=spots)

    # rows that repeat an id are told apart by their text's hash
    return docs.select(F.col(id_col).cast("long"), F.hash(F.col(text_col)), F.col(text_col)).mapInArrow(work, POSTINGS)


def reference_counts(state: DataFrame) -> DataFrame:
    """(h1, h2, n_docs, last_doc): in how many documents each key is, and the largest of them."""
    # first by document, so that a hot key's documents are counted all over the cluster
    per_doc = state.groupBy("h1", "h2", "doc_id").agg(F.count("*").alias("rows"))
    return per_doc.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))


class CuckooFilter:
    """Buckets of four 16-bit fingerprints (Fan et al., 2014) with insertion and deletion.

    Insertion works on whole arrays: in each round every homeless fingerprint
    tries its bucket; one per slot wins, and the rest kick a resident out.  A
    full filter doubles and starts again, so no key is lost.
    """

    def __init__(self, table: np.ndarray):
        self.table = table

    @staticmethod
    def parts(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        m = mix64(h.view(np.uint64))
        return ((m >> np.uint64(48)).astype(np.uint16) | np.uint16(1)), (m & np.uint64(buckets - 1)).astype(np.int64)

    @staticmethod
    def other(bucket: np.ndarray, fp: np.ndarray, buckets: int) -> np.ndarray:
        return bucket ^ (mix64(fp.astype(np.uint64)) & np.uint64(buckets - 1)).astype(np.int64)

    @classmethod
    def build(cls, h: np.ndarray) -> CuckooFilter:
        buckets = 1 << max(1, int(np.ceil(np.log2(max(1, len(h)) / (SLOTS * 0.8)))))
        while True:
            f = cls(np.zeros((buckets, SLOTS), np.uint16))
            if f.insert(h):
                return f
            buckets *= 2

    def insert(self, h: np.ndarray, rounds: int = 400) -> bool:
        n = len(self.table)
        fp, at = self.parts(h, n)
        alt = self.other(at, fp, n)
        free = (self.table == 0).sum(axis=1)
        at = np.where(free[alt] > free[at], alt, at)
        rng = np.random.default_rng(len(h))
        for turn in range(rounds):
            if not len(fp):
                return True
            order = np.argsort(at, kind="stable")
            fp, at = fp[order], at[order]
            first, _ = runs(at)
            # one newcomer a bucket takes a slot in this round, an empty one if there is any
            row = at[first]
            empty = self.table[row] == 0
            slot = np.where(empty.any(axis=1), empty.argmax(axis=1), rng.integers(0, SLOTS, len(row)))
            out = self.table[row, slot]
            self.table[row, slot] = fp[first]
            rest = np.ones(len(fp), bool)
            rest[first] = False
            kicked = out != 0
            moved = self.other(row[kicked], out[kicked], n)
            stay_fp, stay_at = fp[rest], at[rest]
            if turn % 2:
                stay_at = self.other(stay_at, stay_fp, n)
            fp, at = np.concatenate([stay_fp, out[kicked]]), np.concatenate([stay_at, moved])
        return False

    def delete(self, h: np.ndarray) -> None:
        """Take one fingerprint of each key out (keys must have been inserted)."""
        n = len(self.table)
        for f, a in zip(*self.parts(h, n), strict=True):
            for b in (a, int(self.other(np.array([a]), np.array([f]), n)[0])):
                hit = np.flatnonzero(self.table[b] == f)
                if len(hit):
                    self.table[b, hit[0]] = 0
                    break

    def contains(self, h: np.ndarray) -> np.ndarray:
        n = len(self.table)
        fp, at = self.parts(h, n)
        alt = self.other(at, fp, n)
        return (self.table[at] == fp[:, None]).any(axis=1) | (self.table[alt] == fp[:, None]).any(axis=1)


@dataclass(frozen=True)
class LineIndex:
    """The written state of a corpus; see the module's text."""

    postings: DataFrame
    counts: DataFrame
    filters: DataFrame
    min_docs: int = MIN_DOCS
    shards: int = SHARDS

    @property
    def frequent(self) -> DataFrame:
        return self.counts.where(F.col("n_docs") >= self.min_docs)


def _shard(shards: int) -> F.Column:
    return F.pmod("h1", F.lit(shards)).cast("int").alias("shard")


def shards_for(keys: int) -> int:
    """A power of two that gives each shard at most SHARD_KEYS of the frequent keys, about."""
    shards = SHARDS
    while shards * SHARD_KEYS < keys:
        shards *= 2
    return shards


_FILTERS = "shard int, buckets int, filter binary, n_keys long"


def update_filters(filters: DataFrame | None, crossing: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The filters after the keys of ``crossing`` (h1, up) have been inserted (up) or deleted.

    Only shards with a crossing key are loaded.  A filter that cannot take its
    new keys comes back with ``buckets`` 0; :func:`_settled` builds it again.
    """

    def change(key, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        up = new["up"].to_numpy(bool)
        keys = new["h1"].to_numpy(np.int64)
        put, out = np.sort(keys[up]), np.sort(keys[~up])
        if not len(old):
            f, n = CuckooFilter.build(put), len(put)
        else:
            f, n = CuckooFilter(np.frombuffer(old["filter"].iloc[0], np.uint16).reshape(-1, SLOTS).copy()), int(old["n_keys"].iloc[0])
            f.delete(out)
            n += len(put) - len(out)
            if n > 0.9 * f.table.size or not f.insert(put):
                f.table = np.zeros((0, SLOTS), np.uint16)
        return pd.DataFrame({"shard": [int(key[0])], "buckets": np.array([len(f.table)], np.int32), "filter": [f.table.tobytes()], "n_keys": [n]})

    crossing = crossing.select(_shard(shards), "h1", "up")
    if filters is None:
        return crossing.groupBy("shard").applyInPandas(lambda key, pdf: change(key, pdf[:0], pdf), _FILTERS)
    hit = crossing.select("shard").distinct()
    changed = filters.join(hit, "shard", "left_semi").groupBy("shard").cogroup(crossing.groupBy("shard")).applyInPandas(change, _FILTERS)
    return filters.join(hit, "shard", "left_anti").unionByName(changed)


def _settled(filters: DataFrame, frequent: DataFrame, shards: int, name: str) -> DataFrame:
    """The written filters; those that were full are built again from their shards' frequent keys."""
    filters = keep(filters, name)
    full = filters.where("buckets = 0").select("shard")
    if full.isEmpty():
        return filters
    keys = frequent.select(_shard(shards), "h1", F.lit(True).alias("up")).join(full, "shard", "left_semi")
    return keep(filters.where("buckets > 0").unionByName(update_filters(None, keys, shards)), name)


def _built(postings: DataFrame, counts: DataFrame, min_docs: int) -> LineIndex:
    """The index with new filters, over as many shards as its frequent keys ask for."""
    frequent = counts.where(F.col("n_docs") >= min_docs)
    shards = shards_for(frequent.count())
    filters = update_filters(None, frequent.select("h1", F.lit(True).alias("up")), shards)
    return LineIndex(postings, counts, _settled(filters, frequent, shards, "line-filters"), min_docs, shards)


def insert_documents(index: LineIndex | None, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> LineIndex:
    """The index after ``docs`` (whose ids must be new to it) have been added; None is the empty index.

    An index that has outgrown its shards gets new filters over more of them.
    """
    new = keep(postings(docs, id_col, text_col, min_chars), "line-postings")
    more = reference_counts(new)
    if index is None:
        return _built(new, keep(more, "line-counts"), min_docs)
    more = more.withColumnsRenamed({"n_docs": "add", "last_doc": "top"})
    joined = index.counts.join(more, ["h1", "h2"], "full")
    before, after = F.coalesce("n_docs", F.lit(0)), F.coalesce("n_docs", F.lit(0)) + F.coalesce("add", F.lit(0))
    moved = keep(joined.select("h1", "h2", before.alias("before"), after.alias("n_docs"), F.greatest("last_doc", "top").alias("last_doc")), "line-counts")
    counts, both = moved.select("h1", "h2", "n_docs", "last_doc"), index.postings.unionByName(new)
    frequent = counts.where(F.col("n_docs") >= index.min_docs)
    if frequent.count() > 2 * index.shards * SHARD_KEYS:
        return _built(both, counts, index.min_docs)
    up = moved.where((F.col("before") < index.min_docs) & (F.col("n_docs") >= index.min_docs)).select("h1", F.lit(True).alias("up"))
    filters = _settled(update_filters(index.filters, up, index.shards), frequent, index.shards, "line-filters")
    return LineIndex(both, counts, filters, index.min_docs, index.shards)


def delete_documents(index: LineIndex, ids: DataFrame, id_col: str = "doc_id") -> LineIndex:
    """The index after the documents named by ``ids`` have gone."""
    ids = ids.select(F.col(id_col).cast("long").alias("doc_id")).distinct()
    gone = keep(index.postings.join(ids, "doc_id", "left_semi"), "line-gone")
    left = keep(index.postings.join(ids, "doc_id", "left_anti"), "line-postings")
    less = reference_counts(gone).withColumnsRenamed({"n_docs": "less", "last_doc": "top"})
    # a key that lost its largest document takes the next one from the postings of these keys alone
    orphans = index.counts.join(less, ["h1", "h2"]).where(F.col("last_doc") == F.col("top")).select("h1", "h2")
    heirs = left.join(orphans, ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.max("doc_id").alias("heir"))
    joined = index.counts.join(less, ["h1", "h2"], "left").join(heirs, ["h1", "h2"], "left")
    after = F.col("n_docs") - F.coalesce("less", F.lit(0))
    last = F.when(F.col("last_doc") == F.col("top"), F.col("heir")).otherwise(F.col("last_doc"))
    moved = keep(joined.select("h1", "h2", F.col("n_docs").alias("before"), after.alias("n_docs"), last.alias("last_doc")), "line-counts")
    down = moved.where((F.col("before") >= index.min_docs) & (F.col("n_docs") < index.min_docs)).select("h1", F.lit(False).alias("up"))
    counts = moved.where("n_docs > 0").select("h1", "h2", "n_docs", "last_doc")
    filters = _settled(update_filters(index.filters, down, index.shards), counts.where(F.col("n_docs") >= index.min_docs), index.shards, "line-filters")
    return LineIndex(left, counts, filters, index.min_docs, index.shards)


def dropped_lines(index: LineIndex) -> DataFrame:
    """(doc_id, copy, drop): the numbers of the lines that each document loses."""
    slices = index.postings.groupBy(_shard(index.shards)).agg(F.ceil(F.count("*") / F.lit(SLICE_ROWS)).cast("int").alias("slices"))
    slices = keep(slices, "line-slices")
    slices = F.broadcast(slices) if index.shards <= SENT_SHARDS else slices  # a row a shard
    rows = index.postings.withColumn("shard", _shard(index.shards)).join(slices, "shard")
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("doc_id"), "slices").cast("int")).select("shard", "slice", "h1", "h2", "doc_id", "copy", "spots")
    filters = index.filters.join(slices, "shard").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).select("shard", "slice", "filter")

    def test(batch_of_postings: pa.Table, of_filter: pa.Table) -> pa.Table:
        found = batch_of_postings.select(["h1", "h2", "doc_id", "copy", "spots"])
        if not of_filter.num_rows or not found.num_rows:
            return found.slice(0, 0)
        f = CuckooFilter(np.frombuffer(of_filter.column("filter")[0].as_py(), np.uint16).reshape(-1, SLOTS))
        return found.filter(pa.array(f.contains(found.column("h1").to_numpy())))

    maybe = rows.groupBy("shard", "slice").cogroup(filters.groupBy("shard", "slice")).applyInArrow(test, POSTINGS)
    exact = maybe.join(index.frequent.select("h1", "h2", "last_doc"), ["h1", "h2"]).where("doc_id < last_doc")
    return exact.groupBy("doc_id", "copy").agg(F.array_distinct(F.flatten(F.collect_list("spots"))).alias("drop"))  # repeated rows give the same spots


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with columns n_lines, n_dropped and kept_text added."""
    index = insert_documents(None, docs, id_col, text_col, min_chars, min_docs)
    drop = dropped_lines(index).select(F.col("doc_id").alias("__line_id"), F.col("copy").alias("__line_copy"), F.col("drop").alias("__line_drop"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    # hash join: the lists of dropped lines are the small side, and texts need no sort
    joined = docs.join(drop.hint("shuffle_hash"), (F.col(id_col) == F.col("__line_id")) & (F.hash(F.col(text_col)) == F.col("__line_copy")), "left")
    # the one-element array binds the split lines, so that they are made once a text
    parts = F.array(F.struct(F.split(text, "\n", -1).alias("lines"), F.col("__line_drop").alias("drop")))
    left = lambda p: F.array_except(F.sequence(F.lit(0), F.size(p.lines) - 1), p.drop)
    kept = F.get(F.transform(parts, lambda p: F.array_join(F.transform(left(p), lambda i: F.get(p.lines, i)), "\n")), F.lit(0))
    n_lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return joined.select(
        *[docs[c] for c in docs.columns],
        n_lines.cast("long").alias("n_lines"),
        F.when(F.col("__line_drop").isNull(), 0).otherwise(F.size("__line_drop")).cast("long").alias("n_dropped"),
        F.when(F.col("__line_drop").isNull(), text).otherwise(kept).alias("kept_text"),
    )
