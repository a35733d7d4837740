"""Progress topics over event streams: replay, latest state, job queue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest_status(events: DataFrame) -> DataFrame:
    """(user_id, status, n): the last event of each topic; works on batch and stream."""
    at = F.struct("ts", "event_id")
    return events.groupBy("user_id").agg(F.max_by("event_type", at).alias("status"), F.count("*").alias("n"), F.max("event_id").alias("last_event"))


def replay(events: DataFrame) -> DataFrame:
    """Each topic's events in order, up to the first terminal one."""
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    over = F.sum((F.col("event_type") == "purchase").cast("int")).over(order.rowsBetween(W.unboundedPreceding, -1))
    return events.withColumn("seq", F.row_number().over(order)).withColumn("over", F.coalesce(over, F.lit(0))).where("over = 0").select("user_id", "seq", "event_id", "event_type")


def run_latest(stream: DataFrame, name: str):
    """Starts the latest-status query on a stream into a memory table; it ends with the input."""
    return latest_status(stream).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
