"""Section trees kept as (ordinal, level) in reading order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def subtree_ends(sections: DataFrame, key: str, ordinal: str, level: str, levels: int = 3) -> DataFrame:
    """Adds ``next_ordinal``: the first following section that is not below this one (null: none).

    One window a key; the least following ordinal is taken for each level once.
    """
    after = W.partitionBy(key).orderBy(ordinal).rowsBetween(1, W.unboundedFollowing)
    out = F.lit(None).cast("int")
    for k in range(levels):
        out = F.when(F.col(level) == k, F.min(F.when(F.col(level) <= k, F.col(ordinal))).over(after)).otherwise(out)
    return sections.withColumn("next_ordinal", out)


def spread(docs: DataFrame, key: str, text: str, size: int = 16 << 20) -> DataFrame:
    """The documents dealt out by key into parts of about ``size`` bytes of text.

    What groups their words by the key afterwards, or by the key and more, shuffles no word; the parts'
    number follows the texts, since words take far more room in a task than their text.
    """
    parts = -(-(docs.agg(F.sum(F.octet_length(text))).first()[0] or 0) // size)
    return docs.repartition(max(1, parts), key)


def rebuild_inverted(index: DataFrame, key: str, word: str, positions: str) -> DataFrame:
    """(key, text): texts from an inverted index of word positions."""
    at = index.select(key, word, F.explode(positions).alias("pos"))
    words = F.array_sort(F.collect_list(F.struct("pos", word)))
    return at.groupBy(key).agg(F.array_join(F.transform(words, lambda x: x[word]), " ").alias("text"))
