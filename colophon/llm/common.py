"""Helpers shared by the training-data operators.

Intermediate tables that cut lineage are written below the folder that the
session names in ``spark.checkpoint.dir``; every executor sees that folder, so a
lost executor costs only the tasks it ran.  Where the setting is missing, a local
session (unit tests) gets a folder of its own, and any other raises an error.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The six ASCII white-space characters that the contracts name, as a regex class.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows per blob bucket that one task of a bucketed stage should hold, about.
BUCKET_BYTES = 24 << 20


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, as the session names it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-colophon-")  # one machine: unit tests
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return the reread table."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/colophon/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete every intermediate table of this application.

    Call it when the results that were built on them have been written.
    """
    path = f"{scratch_root(spark)}/colophon/{spark.sparkContext.applicationId}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: Column | str) -> Column:
    """crc32 of the id as text leaves 2 by 4: rows that no model may learn from."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def arrow_map(df: DataFrame, func: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(func, schema)


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A record batch with the columns cast to ``schema``."""
    arrays = []
    for field in schema:
        x = columns[field.name]
        arrays.append(x.cast(field.type) if isinstance(x, pa.Array) else pa.array(x, type=field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal keys in a sorted array."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))
    return first, np.diff(np.append(first, len(sorted_keys)))


#: A key is hot if it holds more than this share of the rows; so there are at most HOT of them.
HOT = 1000


def join_hot(rows: DataFrame, facts: DataFrame, keys: list[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``facts``, one row a key, whose ``count`` says how many of the ``total`` rows have the key.

    Facts of hot keys are sent to every task (HOT rows at most, since the counts
    add up to the total), so their rows stay where they are; the others are joined by a shuffle.
    ``how`` is inner or left.
    """
    hot = F.col(count) * HOT > total
    marked = rows.join(F.broadcast(facts.where(hot)), keys, "left")
    new = [c for c in facts.columns if c not in keys]
    rest = marked.where(F.col(count).isNull()).drop(*new).join(facts.where(~hot), keys, how)
    return marked.where(F.col(count).isNotNull()).unionByName(rest)


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of an edge list: (node, component), component = least node.

    Alternating large-star and small-star rounds (Kiveris et al., 2014); every
    round is two shuffles of the edge list, and nothing reaches the driver but
    one sum.  Self loops keep isolated nodes; null ends are dropped; an empty
    list gives an empty table.  The star of a hub is never gathered: its
    minimum is a partial aggregate, joined back with AQE's skew handling.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    e = keep(e.distinct(), "cc-edges")
    nodes = e.select(F.col("u").alias("node")).union(e.select("v")).distinct()
    e = e.where("u <> v")
    before = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: every larger neighbour of u points to the least of u's neighbourhood
        e1 = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u's smaller neighbours and u itself point to the least of them
        down = e1.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low2 = down.groupBy("u").agg(F.min("v").alias("m"))
        e2 = down.join(low2, "u")
        e = keep(e2.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low2.select("u", F.col("m").alias("v"))).distinct(), "cc")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    root = e.groupBy("u").agg(F.min("v").alias("v"))
    return nodes.join(root, nodes.node == root.u, "left").select("node", F.coalesce("v", "node").alias("component"))


def with_type(df: DataFrame, name: str, kind: T.DataType) -> DataFrame:
    return df.withColumn(name, F.col(name).cast(kind))
