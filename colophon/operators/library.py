"""Listings, groups, sessions, filters and citations of a document library."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNSET = "unset"


def optional_filters(df: DataFrame, **wanted) -> DataFrame:
    """A conjunction in which a falsy value asks for nothing."""
    parts = [F.col(k) == v for k, v in wanted.items() if v]
    return df.where(reduce(lambda a, b: a & b, parts)) if parts else df


def page_of(df: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    return df.orderBy(*order).offset((max(page, 1) - 1) * size).limit(size)


def group_by_field(df: DataFrame, field: str, item: str) -> DataFrame:
    """(field, n, newest): groups with their count and five newest items; the unset group is last by order key."""
    name = F.when(F.coalesce(F.col(field), F.lit("")) == "", UNSET).otherwise(F.col(field))
    rows = df.select(name.alias("name"), F.col(item).alias("item"))
    count = rows.groupBy("name").agg(F.count("*").alias("n"))
    rank = F.row_number().over(W.partitionBy("name").orderBy(F.col("item").desc()))
    # the limit on the rank is applied before the exchange, so a large group sends five rows a task
    top = rows.withColumn("rank", rank).where(F.col("rank") <= 5).groupBy("name").agg(F.array_sort(F.collect_list("item")).alias("items"))
    newest = F.array_join(F.transform("items", lambda x: x.cast("string")), ",")
    return count.join(top, "name").select("name", "n", newest.alias("newest"), (F.col("name") == UNSET).alias("unset"))


def relax(strict: Column, looser: list[Column]) -> Column:
    """The level of the first predicate that a row meets (0 is strict); null if none."""
    out = F.when(strict, 0)
    for i, p in enumerate(looser):
        out = out.when(p, i + 1)
    return out


def relaxed_filter(df: DataFrame, strict: Column, looser: list[Column]) -> DataFrame:
    """The rows of the strictest predicate that any row meets, with its ``level``."""
    levels = df.withColumn("level", relax(strict, looser)).where("level IS NOT NULL")
    best = levels.agg(F.min("level").alias("best"))
    picked = levels.join(F.broadcast(best))  # one row
    return picked.where(F.col("level") <= F.col("best")).drop("best")


def keep_all_if_none(df: DataFrame, hit: Column) -> DataFrame:
    """Rows that are hit; all rows if none is."""
    any_hit = df.agg(F.coalesce(F.max(hit.cast("int")), F.lit(0)).alias("any_hit"))
    return df.join(F.broadcast(any_hit)).where(hit | (F.col("any_hit") == 0)).drop("any_hit")  # one row


def sessions(messages: DataFrame, width: int = 30) -> DataFrame:
    """(session, title, last): the first user message names the session."""
    first = F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn")))
    out = messages.groupBy("conv_id").agg(first.alias("first"), F.max("turn").alias("last_turn"), F.count("*").alias("n"))
    title = F.coalesce("first", F.col("conv_id").cast("string"))
    return out.select("conv_id", F.when(F.length(title) > width, F.concat(F.substring(title, 1, width), F.lit("..."))).otherwise(title).alias("title"), "last_turn", "n")


def latest(messages: DataFrame, n: int) -> DataFrame:
    """The last n messages of each session."""
    rank = F.row_number().over(W.partitionBy("conv_id").orderBy(F.col("turn").desc()))
    return messages.withColumn("back", rank).where(F.col("back") <= n)


#: Kinds of quote keys, longest first: (least bytes of a quote, bytes of a gram).  The first two kinds
#: take the grams of least hash in any stretch of so many bytes; shorter quotes meet all grams.
QUOTE_KEYS = ((48, 16), (24, 8), (12, 12), (6, 6), (3, 3), (1, 1))


def _gram_hashes(data: np.ndarray, gram: int, kind: int) -> np.ndarray:
    n = len(data) - gram + 1
    h = np.full(max(n, 0), kind + 1, np.uint64)
    for j in range(gram if n > 0 else 0):
        h = h * np.uint64(0x9E3779B97F4A7C15) + data[j : j + n]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(29)


def _quote_key(data: np.ndarray) -> tuple[int, np.uint64]:
    """The kind and key of a quote: the gram of least hash, which every text that holds the quote gives too."""
    kind = next(k for k, (least, _) in enumerate(QUOTE_KEYS) if len(data) >= least)
    return kind, _gram_hashes(data, QUOTE_KEYS[kind][1], kind).min()


def _body_keys(data: np.ndarray, kinds: list[int]) -> np.ndarray:
    """All keys that quotes of these kinds within a text can have."""
    out = [np.zeros(0, np.uint64)]
    for kind in kinds:
        least, gram = QUOTE_KEYS[kind]
        h = _gram_hashes(data, gram, kind)
        if len(data) >= least:
            out.append(np.unique(np.lib.stride_tricks.sliding_window_view(h, least - gram + 1).min(1)))
    return np.concatenate(out)


def _text_keys(df: DataFrame, id_col: str, text_col: str, kinds: list[int] | None) -> DataFrame:
    """(id, kind, key) of quotes, or of bodies for the given kinds."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, found, of = [], [], []
            for i, text in enumerate(b.column(1).cast(pa.binary())):
                data = np.frombuffer(text.as_py(), np.uint8)
                kind, keys = (0, _body_keys(data, kinds)) if kinds is not None else _quote_key(data)
                keys = np.atleast_1d(keys)
                at.append(np.full(len(keys), i))
                of.append(np.full(len(keys), kind, np.int32))
                found.append(keys)
            if at:
                ids = b.column(0).take(pa.array(np.concatenate(at)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate(of)), pa.array(np.concatenate(found).view(np.int64))], names=[id_col, "kind", "key"])

    rows = df.select(id_col, text_col)
    schema = T.StructType([T.StructField(id_col, rows.schema[id_col].dataType), T.StructField("kind", T.IntegerType()), T.StructField("key", T.LongType())])
    return rows.mapInArrow(work, schema)


def verify_quotes(quotes: DataFrame, chunks: DataFrame, min_words: int = 1) -> DataFrame:
    """(item_id, doc_id): documents that hold a quote, compared without case, blanks and punctuation.

    Candidates share a gram of the stripped texts, whatever the words' boundaries,
    so no quote meets all documents.  Quotes without letters or digits are left out.
    """
    norm = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", "")
    words = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}_]+"), lambda x: x != "")
    q = quotes.where(F.size(words(F.col("text"))) >= max(1, min_words)).select("item_id", norm(F.col("text")).alias("quote"))
    bodies = chunks.where("text IS NOT NULL").select("doc_id", norm(F.col("text")).alias("body"))
    asked = _text_keys(q, "item_id", "quote", None)
    kinds = sorted(r.kind for r in asked.select("kind").distinct().collect())  # six at most
    given = _text_keys(bodies, "doc_id", "body", kinds)
    hits = given.select("doc_id", "key").join(asked.select("item_id", "key"), "key").select("doc_id", "item_id").distinct()
    return hits.join(bodies, "doc_id").join(q, "item_id").where(F.contains("body", F.col("quote"))).select("item_id", "doc_id")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)
