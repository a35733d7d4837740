"""The tree merge: every node has its own task, and ids of any size keep their order."""

import random

from pyspark.sql import functions as F

from colophon.llm import exact_dedup
from colophon.llm.common import partitions


def test_no_idle_node(spark):
    rows = spark.createDataFrame([(i, f"text {i % 900}") for i in range(4000)], "doc_id long, text string")
    merged = exact_dedup.merge_runs(exact_dedup.digest_runs(rows))
    for nodes in (2, 8, 256):
        labels = spark.createDataFrame([(k, x) for k, x in enumerate(exact_dedup.node_labels(spark, nodes))], "k int, x int")
        assert labels.count() == nodes and labels.where(F.pmod(F.hash("x"), F.lit(nodes)) != F.col("k")).isEmpty()
    held = {r.p: r["count"] for r in merged.groupBy(F.spark_partition_id().alias("p")).count().collect()}
    assert sum(held.values()) == 900 and len(held) == partitions(spark)


def test_least_and_largest_ids(spark):
    low, high = -(1 << 63), (1 << 63) - 1
    rng = random.Random(1)
    texts = {low: "a b", high: "ab", 0: "a\tb", -5: "ab ", 7: "other", 8: "o ther", None: "other  "}
    rows = [(i, t) for i, t in texts.items()]
    rng.shuffle(rows)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # three code points beat two; of those the least id stays
    assert {i: got[i] for i in (low, high, 0, -5)} == {low: (low, 4, True), high: (low, 4, False), 0: (low, 4, False), -5: (low, 4, False)}
    assert got[None][0] is None and got[7][:2] == (None, 3) and not got[7][2]  # the longest original has no id
