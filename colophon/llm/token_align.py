"""Alignment of two tokenisations of each text, and corpus-wide counts of the token pairs that meet.

The documents are shuffled by their full text, with a count for each distinct
text (partial counts first, so copies of one text never gather), and each distinct
text is tokenised and aligned once.  Tokens are byte ranges of the same bytes: a
link is a pair of tokens whose ranges overlap, and there is one for every piece
between neighbouring token ends of either side; where both sides end, a group ends.

Texts are cut into blocks of about ``BLOCK`` tokens.  A block keeps a dictionary of
its different id pairs with their counts, weighted by the texts' multiplicity, and
each text keeps the places of its pairs in that dictionary.  So the corpus-wide
counts are summed from dictionaries, not from links, and return to the blocks the
same way; then each text's measures are taken in its block and joined to the
documents by the text's SHA-256, which stands for it in that last join.

Defined results: a null or empty text, or one that either tokeniser does not
give back byte for byte, has no tokens: zeros and no groups.  Rows are returned
for every input row, repeated or without id; extra columns are ignored; very long
texts are blocks of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, join_hot, keep
from .tokens import SPECIAL, byte_ids, byte_ranks, piece_ids, piece_model, tokenizer_folder

#: Tokens of both sides in a block, about; and characters that are tokenised at a time.
BLOCK, CHUNK = 1 << 21, 1 << 20
_INT = pa.int64()
#: Fields of a text that the documents receive.
MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


class Vocabulary:
    """Bytes of every id on both sides, their lengths, and the decimals that spell the groups."""

    def __init__(self, folder: str):
        ranks = byte_ranks(folder)
        self.a = [b""] * (len(ranks) + 1)
        for piece, i in ranks.items():
            self.a[i] = piece
        self.a[-1] = SPECIAL.encode()
        model = piece_model(folder)
        self.b = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in range(model.get_piece_size())]
        self.len_a, self.len_b = (np.array([len(p) for p in side], np.int64) for side in (self.a, self.b))
        #: id * 2 + (last of its group), the second side after the first
        self.spelt = [f"{i}{end}".encode() for side, last in ((self.a, "|"), (self.b, ";")) for i in range(len(side)) for end in (",", last)]


@lru_cache(maxsize=1)
def vocabulary(folder: str) -> Vocabulary:
    return Vocabulary(folder)


def tokenised(texts: list[str], folder: str) -> tuple[list[list[int]], list[list[int]]]:
    """Ids of both sides; none where a side's bytes are not space and text."""
    v = vocabulary(folder)
    a, b = byte_ids([" " + t for t in texts], folder, plain=True), piece_ids(texts, folder)
    for i, t in enumerate(texts):
        want = (" " + t).encode()
        if not t or b"".join(map(v.a.__getitem__, a[i])) != want or b"".join(map(v.b.__getitem__, b[i])) != want:
            a[i], b[i] = [], []
    return a, b


class Aligned:
    """Links, groups and pair codes of a run of texts, one after the other."""

    def __init__(self, a: list[list[int]], b: list[list[int]], v: Vocabulary):
        self.n_a, self.n_b = (np.array([len(x) for x in side], np.int64) for side in (a, b))
        ids_a, ids_b = (np.fromiter((i for x in side for i in x), np.int64, int(n.sum())) for side, n in ((a, self.n_a), (b, self.n_b)))
        ends_a, ends_b = np.cumsum(v.len_a[ids_a]), np.cumsum(v.len_b[ids_b])
        size = int(ends_a[-1]) + 1 if len(ends_a) else 1
        at_a, at_b = np.zeros(size, bool), np.zeros(size, bool)
        at_a[ends_a] = at_b[ends_b] = True
        last_a, last_b = at_b[ends_a], at_a[ends_b]  # the last tokens of their groups
        ends = np.flatnonzero(at_a | at_b)
        of = lambda mark: np.cumsum(mark) - mark  # noqa: E731  tokens that ended before
        self.codes = ids_a[of(at_a[ends])] * len(v.b) + ids_b[of(at_b[ends])]
        # a text's links are its tokens less one for each end that both sides share
        starts = lambda n: np.concatenate(([0], np.cumsum(n)))
        shared = starts(last_a)
        self.n_groups = np.diff(shared[starts(self.n_a)])
        self.n_links = self.n_a + self.n_b - self.n_groups
        # tokens in the order of the groups' spelling: a group's first side, then its second
        past_a, past_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1
        spelt = np.empty(len(ids_a) + len(ids_b), np.int64)
        spelt[np.arange(len(ids_a)) + np.concatenate(([0], past_b))[of(last_a)]] = 2 * ids_a + last_a
        spelt[np.arange(len(ids_b)) + past_a[of(last_b)]] = 2 * (len(v.a) + ids_b) + last_b
        place, spelt = starts(self.n_a + self.n_b), spelt.tolist()
        self.digests = [_spelling(spelt[lo:hi], v) for lo, hi in zip(place, place[1:], strict=False)]


def _spelling(tokens: list[int], v: Vocabulary) -> str:
    return hashlib.sha256(b"".join(map(v.spelt.__getitem__, tokens))[:-1]).hexdigest() if tokens else ""


_TEXTS = pa.schema([("block", _INT), ("digest", pa.binary()), *((n, _INT) for n in ("n", "n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), ("place", pa.list_(pa.int32())), ("times", pa.list_(_INT)), ("codes", pa.list_(_INT)), ("weights", pa.list_(_INT))])
_TEXTS_DDL = "block long, digest binary, n long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, place array<int>, times array<long>, codes array<long>, weights array<long>"


def _lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(values, kind))


def block_rows(block: int, digests: list[bytes], times: list[int], parts: list[Aligned]) -> Iterator[pa.RecordBatch]:
    """The block's texts, each with the places and numbers of its pairs, and a row with the dictionary of pairs."""
    join = lambda name: np.concatenate([getattr(p, name) for p in parts])
    links, codes, n = join("n_links"), join("codes"), np.array(times, np.int64)
    pairs, k = np.unique(np.repeat(np.arange(len(n)), links) << 32 | codes, return_counts=True)
    text, codes = pairs >> 32, pairs & 0xFFFFFFFF
    known, place = np.unique(codes, return_inverse=True)
    weights = np.bincount(place, k * n[text], len(known)).astype(np.int64)
    sizes = np.bincount(text, minlength=len(n))
    none = pa.nulls(len(n), pa.list_(_INT))
    yield batch(
        _TEXTS, block=pa.array(np.full(len(n), block)), digest=pa.array(digests, pa.binary()), n=pa.array(n), n_a=pa.array(join("n_a")), n_b=pa.array(join("n_b")), n_groups=pa.array(join("n_groups")), n_links=pa.array(links),
        groups_sha256=[d for p in parts for d in p.digests], place=_lists(place.astype(np.int32), sizes, pa.int32()), times=_lists(k, sizes, _INT), codes=none, weights=none,
    )
    rest = {name: [None] for name in _TEXTS.names}
    yield batch(_TEXTS, **rest | {"block": [block], "codes": _lists(known, [len(known)], _INT), "weights": _lists(weights, [len(known)], _INT)})


def encoded(texts: DataFrame, folder: str | None = None, block: int = BLOCK) -> DataFrame:
    """Texts (text, digest, n), each distinct, as the rows of :func:`block_rows`."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = folder or tokenizer_folder()  # where this executor has it
        v, at = vocabulary(place), TaskContext.get().partitionId() << 32
        digests, times, parts, size = [], [], [], 0
        for b in batches:
            for lo, hi in _spans(b.column("text")):
                digests += b.column("digest")[lo:hi].to_pylist()
                times += b.column("n")[lo:hi].to_pylist()
                parts.append(Aligned(*tokenised(b.column("text")[lo:hi].to_pylist(), place), v))
                size += int(parts[-1].n_a.sum() + parts[-1].n_b.sum())
                if size >= block:
                    yield from block_rows(at, digests, times, parts)
                    digests, times, parts, size, at = [], [], [], 0, at + 1
        if parts:
            yield from block_rows(at, digests, times, parts)

    return texts.select("text", "digest", "n").mapInArrow(work, _TEXTS_DDL)


def _spans(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows of about CHUNK bytes."""
    sizes = np.cumsum([len(s.as_buffer()) if s.is_valid else 0 for s in column])
    lo = 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + CHUNK, "right")))
        yield lo, hi
        lo = hi


def pair_counts(blocks: DataFrame, n_b: int) -> tuple[DataFrame, DataFrame]:
    """(block, place, code) of the dictionaries, and (code, links, best) over the corpus.

    ``best`` marks the pairs of the highest count of their second id; those ids are at
    most the ``n_b`` of the vocabulary, a bound that does not grow with the corpus.
    """
    pairs = blocks.where("codes IS NOT NULL").select("block", F.posexplode(F.arrays_zip("codes", "weights")).alias("place", "p")).select("block", "place", "p.codes", "p.weights").toDF("block", "place", "code", "weight")
    counts = keep(pairs.groupBy("code").agg(F.sum("weight").alias("links")).withColumn("b", F.col("code") % n_b), "pair-counts")
    top = F.broadcast(counts.groupBy("b").agg(F.max("links").alias("top")))
    return pairs.drop("weight"), counts.join(top, "b").select("code", "links", (F.col("links") == F.col("top")).alias("best"))


def measured(blocks: DataFrame, known: DataFrame) -> DataFrame:
    """(digest, n, measures, groups_sha256) of every distinct text, block by block."""
    names = ("n", *MEASURES)
    schema = pa.schema([("digest", pa.binary()), *((n, _INT) for n in names), ("groups_sha256", pa.string())])

    def work(texts: pa.Table, dictionary: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return schema.empty_table()
        texts, dictionary = texts.combine_chunks(), dictionary.sort_by("place")
        links, best = dictionary.column("links").to_numpy(), dictionary.column("best").to_numpy(zero_copy_only=False)
        place, times = (texts.column(c).combine_chunks() for c in ("place", "times"))
        sizes = place.value_lengths().to_numpy(zero_copy_only=False)
        edges = np.concatenate(([0], np.cumsum(sizes)))
        place, times = place.flatten().to_numpy(zero_copy_only=False), times.flatten().to_numpy(zero_copy_only=False)
        summed = lambda x: np.diff(np.concatenate(([0], np.cumsum(x, dtype=np.int64)))[edges])
        new = {"n_best": pa.array(summed(times * best[place])), "count_sum": pa.array(summed(times * links[place]))}
        return pa.table([new.get(f.name, texts.column(f.name) if f.name not in new else None) for f in schema], schema=schema)

    texts = blocks.where("digest IS NOT NULL").drop("codes", "weights")
    ddl = "digest binary, " + ", ".join(f"{n} long" for n in names) + ", groups_sha256 string"
    return texts.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(work, ddl)


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    distinct = rows.groupBy("text").agg(F.count("*").alias("n")).withColumn("digest", digest)
    blocks = keep(encoded(distinct, folder, block), "aligned-blocks")
    pairs, counts = pair_counts(blocks, piece_model(folder or tokenizer_folder()).get_piece_size())
    known = pairs.join(counts, "code").select("block", "place", "links", "best")
    facts = keep(measured(blocks, known), "text-measures")
    total = facts.agg(F.sum("n")).first()[0] or 0
    out = join_hot(rows.select("doc_id", digest.alias("digest")), facts, ["digest"], "n", total)
    return out.select("doc_id", *MEASURES, "groups_sha256")
