"""Exact dedup by a tree merge of sorted digest runs (native columns only).

Every partition of the corpus is a run: its rows carry the 64-bit digest of the
normalised text, sorted by it.  ``2**bits`` nodes merge the runs in binomial
rounds.  In a round each node hands every row to the partner that agrees with
the digest in the next ``RADIX_BITS`` bits and with the node in all others: rows
move by node (one exchange, on ``node`` alone), and the receiver merges its
``2**RADIX_BITS`` runs in the order of their digests.  Equal digests meet there,
are verified (SHA-256 and length of the normalised text must agree), and keep
one representative and a count, which is all that the next round moves.  After
``bits / RADIX_BITS`` rounds each node owns one digest range, fully merged.

A group that holds a third of the corpus starts on as many nodes as partitions
and shrinks to one row a node in the first merge, so no task ever gets it as
rows.  On the way back, the few groups above 1/HOT of all rows are
sent to every task (at most HOT of them), the others are joined.

Defined results: null text counts as empty, and all empty texts form one group;
a repeated row counts as a member of its group each time, and rows that share
id and text are all marked kept or all not; a null id only stays where no other
row can; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, join_hot, keep, partitions

#: Bits of the digest that one round settles: each round merges 2**RADIX_BITS runs.
RADIX_BITS = 2


def digest_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, sha, norm_len, n_chars), one sorted run for each partition."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.col(id_col).alias("id"), F.length(text).cast("long").alias("n_chars"), F.regexp_replace(text, f"{SPACE}+", "").alias("norm"))
    df = df.select("id", F.xxhash64("norm").alias("digest"), F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("sha"), F.octet_length("norm").alias("norm_len"), "n_chars")
    return df.sortWithinPartitions("digest")


def node_labels(spark: SparkSession, nodes: int) -> list[int]:
    """A label for each node, such that Spark's hash of it is the node's number: every node has a task of its own."""
    tried = 64 * nodes  # each number is hit about 64 times
    found = spark.range(tried).select(F.col("id").cast("int").alias("label")).groupBy(F.pmod(F.hash("label"), F.lit(nodes)).alias("node")).agg(F.min("label").alias("label"))
    return [r.label for r in found.orderBy("node").collect()]  # a row a node


def merge_runs(runs: DataFrame) -> DataFrame:
    """(digest, sha, norm_len, keep_id, group_size): one row for each distinct text."""
    bits = max(1, ceil(log2(max(2, partitions(runs.sparkSession)))))
    nodes = 1 << bits
    labels = node_labels(runs.sparkSession, nodes)
    label = F.lit(labels) if len(labels) == nodes else F.sequence(F.lit(0), F.lit(nodes - 1))
    level = runs.select(
        "digest", "sha", "norm_len",
        # the complement turns the order of ids and cannot overflow
        F.struct(F.col("n_chars").alias("n"), F.bitwise_not("id").alias("id")).alias("best"),
        F.lit(1).cast("long").alias("size"),
        F.pmod(F.spark_partition_id(), F.lit(nodes)).alias("number"),
    )
    for low in range(0, bits, RADIX_BITS):
        window = ((1 << min(RADIX_BITS, bits - low)) - 1) << low
        partner = F.col("number").bitwiseAND(F.lit(nodes - 1 - window)).bitwiseOR(F.pmod("digest", F.lit(nodes)).cast("int").bitwiseAND(F.lit(window)))
        received = level.withColumn("number", partner).withColumn("node", F.get(label, F.col("number"))).repartition(nodes, "node")
        # grouped within the node: the planner sorts by these keys and merges neighbours, without another exchange
        level = received.groupBy("node", "number", "digest", "sha", "norm_len").agg(F.max("best").alias("best"), F.sum("size").alias("size"))
    return level.select("digest", "sha", "norm_len", F.bitwise_not(F.col("best.id")).alias("keep_id"), F.col("size").alias("group_size"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256), one row for each input row.

    Of equal texts the longest original stays, then the smallest id.
    """
    runs = keep(digest_runs(docs, id_col, text_col), "digest-runs")
    groups = keep(merge_runs(runs), "digest-groups")
    n = groups.agg(F.sum("group_size")).first()[0] or 0
    joined = join_hot(runs, groups, ["digest", "sha", "norm_len"], "group_size", n)
    return joined.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
