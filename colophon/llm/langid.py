"""Language identification with language-bitmask n-gram filters.

Letter 4-grams (with word ends) are counted for each language by Spark.  A
language has an n-gram if its share of the language's n-grams is not far below
the largest share in any language.  Bit-sliced Bloom filters store this: a slot
holds a bitmask of languages, and the AND of an n-gram's slots returns all
languages that contain it at once.  A text's n-grams are popcounted for each
language, the false positives expected from the language's fill are taken off,
and the largest count decides.

The slots follow the number of n-grams, ``SLOTS`` for each at least, so no filter
fills up; n-grams are at most 64**4 for corpora of any size, and a slot takes a bit a
language, so the filters have a bound and can be sent to every task.  Masks have as
many words as the languages need; more than ``MOST`` languages raise an error.

Defined results: ``und`` with score 0 if the text is null or has no letter, or
nothing could be learnt; ties go to the language that is first by name; if no
language has any n-gram of the text, the most frequent one is named with score
0; rows are handled one by one, so repeated rows are answered each; labels that
are null are not learnt from; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, held_out, keep, mix64
from .symbols import chunks, symbols

HASHES = 3
#: Slots for each n-gram, at least: a filter that held all of them would be filled to 1 - exp(-3/8), a third.
SLOTS = 8
#: Languages in one word of a mask, and languages at most, which is checked.
WORD, MOST = 64, 4096
#: A language has an n-gram whose share reaches this part of the largest share.
SHARE = 0.25
MIN_COUNT = 2
#: Codes: 24 bits for 4-grams, and above them the one-letter words.
CODES = (1 << 24) + 64


def ngram_codes(cps: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams of joined texts, and the row of each.

    A 4-gram's two middle symbols are letters, so it lies in one word with its
    ends at most; words of one letter have a code of their own.
    """
    s = np.concatenate([[0], symbols(cps), [0, 0]]).astype(np.uint32)
    a, b, c, d = s[:-3], s[1:-2], s[2:-1], s[3:]
    at = np.flatnonzero((b != 0) & (c != 0))
    four = a[at] << 18 | b[at] << 12 | c[at] << 6 | d[at]
    one = np.flatnonzero((a == 0) & (b != 0) & (c == 0))
    codes = np.concatenate([four, b[one] + np.uint32(1 << 24)])
    # position i of the windows is code point i; the last window only has the blank
    return codes, row[np.minimum(np.concatenate([at, one]), len(row) - 1)]


def count_ngrams(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, code, n) over all given documents."""
    schema = pa.schema([("lang", pa.string()), ("code", pa.int32()), ("n", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def rows():
            for b in batches:
                for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    yield lang, text.as_py() or ""

        for held, cps, row in chunks(rows()):
            codes, of = ngram_codes(cps, row)
            langs = sorted({r[0] for r in held})
            number = np.array([langs.index(r[0]) for r in held], np.int64)
            keys, n = np.unique(number[of] << 25 | codes.astype(np.int64), return_counts=True)
            for k, lang in enumerate(langs):
                mine = keys >> 25 == k
                old_codes, old_n = sums.get(lang, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                both, back = np.unique(np.concatenate([old_codes, keys[mine] & (1 << 25) - 1]), return_inverse=True)
                sums[lang] = both, np.bincount(back, np.concatenate([old_n, n[mine]]), len(both)).astype(np.int64)
        for lang, (codes, n) in sums.items():
            yield batch(schema, lang=[lang] * len(codes), code=pa.array(codes.astype(np.int32)), n=pa.array(n))

    return docs.select(F.col(lang_col), F.col(text_col)).mapInArrow(work, "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def slots(codes: np.ndarray, k: int, size: int) -> np.ndarray:
    return (mix64(codes.astype(np.uint64) + np.uint64((k + 1) << 40)) & np.uint64(size - 1)).astype(np.int64)


class LanguageFilter:
    """The bit-sliced Bloom filters of all languages: a row of slots for each word of the masks."""

    def __init__(self, langs: list[str], prior: str | None, table: np.ndarray):
        self.langs, self.prior, self.table = langs, prior, np.atleast_2d(table)
        fill = np.array([(self.table[i // WORD] >> np.uint64(i % WORD) & np.uint64(1)).mean() for i in range(len(langs))])
        self.fill, self.false_rate = fill, fill**HASHES
        narrow = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if min(len(langs), WORD) <= 8 * np.dtype(t).itemsize)
        self.small = self.table.astype(narrow)
        self.memo = None

    def _look(self, codes: np.ndarray) -> np.ndarray:
        m = self.small[:, slots(codes, 0, self.small.shape[1])]
        for k in range(1, HASHES):
            m = m & self.small[:, slots(codes, k, self.small.shape[1])]
        return m

    def masks(self, codes: np.ndarray) -> np.ndarray:
        """The languages that contain each n-gram, a row a word; answers of one word are remembered by code."""
        if len(self.small) > 1:  # a memory of many words would be larger than the filters
            new, back = np.unique(codes, return_inverse=True)
            return self._look(new)[:, back]
        if self.memo is None:
            self.memo, self.known = np.zeros(CODES, self.small.dtype), np.zeros(CODES, bool)
        new = np.unique(codes[~self.known[codes]])
        if len(new):
            self.memo[new], self.known[new] = self._look(new)[0], True
        return self.memo[codes][None]

    def decide(self, codes: np.ndarray, of: np.ndarray, rows: int) -> tuple[list[str], np.ndarray]:
        total = np.bincount(of, minlength=rows)
        m = self.masks(codes)
        counts = np.zeros((rows, len(self.langs)))
        for i in range(len(self.langs)):
            word = m[i // WORD]
            counts[:, i] = np.bincount(of[(word >> word.dtype.type(i % WORD) & word.dtype.type(1)).astype(bool)], minlength=rows)
        true = np.maximum((counts - self.false_rate * total[:, None]) / (1 - self.false_rate), 0) if len(self.langs) else counts
        best = true.argmax(1) if len(self.langs) else np.zeros(rows, int)
        top = true.max(1) if len(self.langs) else np.zeros(rows)
        score = np.where(top > 0, top / np.maximum(true.sum(1) if len(self.langs) else 1, 1e-9), 0.0)
        names = [("und" if not t or self.prior is None else self.langs[k] if x > 0 else self.prior) for t, k, x in zip(total, best, top, strict=True)]
        return names, np.where(total > 0, np.clip(score, 0, 1), 0.0)


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageFilter:
    """Filters of the languages in ``docs`` (rows without a language are skipped)."""
    counts = keep(count_ngrams(docs.where(F.col(lang_col).isNotNull()), text_col, lang_col), "ngram-counts")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total")).orderBy("lang").limit(MOST + 1).collect()
    if len(totals) > MOST:
        raise ValueError(f"more than {MOST} languages")
    langs = [r.lang for r in totals]
    if not langs:
        return LanguageFilter([], None, np.zeros((1, 2), np.uint64))
    spark = docs.sparkSession
    # MOST rows at most
    share = counts.join(F.broadcast(spark.createDataFrame([(r.lang, i // WORD, i % WORD, float(r.total)) for i, r in enumerate(totals)], "lang string, word int, bit int, total double")), "lang")
    share = share.where(F.col("n") >= MIN_COUNT).withColumn("share", F.col("n") / F.col("total"))
    top = share.groupBy("code").agg(F.max("share").alias("top"))
    held = share.join(top, "code").where(F.col("share") >= SHARE * F.col("top"))
    masks = keep(held.groupBy("code", "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask")), "ngram-masks")
    # n-grams are at most CODES, however large the corpus; so are the slots
    size = 1 << 10
    while size < SLOTS * masks.select("code").distinct().count():
        size *= 2

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("word", pa.int32()), ("slot", pa.int32()), ("mask", pa.int64())])
        for b in batches:
            codes, mask, word = (b.column(c).to_numpy(zero_copy_only=False) for c in ("code", "mask", "word"))
            yield batch(schema, word=pa.array(np.tile(word, HASHES)), slot=pa.array(np.concatenate([slots(codes, k, size) for k in range(HASHES)]).astype(np.int32)), mask=pa.array(np.tile(mask, HASHES)))

    filled = masks.mapInArrow(spread, "word int, slot int, mask long").groupBy("word", "slot").agg(F.bit_or("mask").alias("mask")).toArrow()  # slots times words at most
    table = np.zeros((-(-len(langs) // WORD), size), np.uint64)
    table[filled.column("word").to_numpy(), filled.column("slot").to_numpy()] = filled.column("mask").to_numpy().astype(np.uint64)
    prior = max(totals, key=lambda r: (r.total, r.lang)).lang
    return LanguageFilter(langs, prior, table)


def predict(docs: DataFrame, model: LanguageFilter, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every document."""
    sent = docs.sparkSession.sparkContext.broadcast((model.langs, model.prior, model.table))
    schema = pa.schema([("id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = LanguageFilter(*sent.value)

        def rows():
            for b in batches:
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    yield doc_id, text.as_py() or ""

        for held, cps, row in chunks(rows()):
            codes, of = ngram_codes(cps, row)
            names, score = own.decide(codes, of, len(held))
            yield batch(schema, id=[r[0] for r in held], lang_pred=names, score=pa.array(score))

    out = docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(work, "id long, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score): learns from the rows that are not held out."""
    model = learn(docs.where(~held_out(id_col)), text_col, lang_col)
    out = predict(docs, model, id_col, text_col)
    return out.select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")
