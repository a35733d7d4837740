"""Checkpoints of conversations, a version a message, and topics that always end; each on batch tables and on streams.

A stream keeps its own state and the offsets that it has read below its
checkpoint folder, so a query that is stopped and started again goes on where it was.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# --- versions of a conversation ----------------------------------------------


def thread_of(thread: Column, session: Column) -> Column:
    """The thread a session's checkpoints belong to: its own id where none is configured."""
    return F.coalesce(thread, session.cast("string"))


def versions(messages: DataFrame) -> DataFrame:
    """(thread, version, parent, turn, messages, chars, asked): the state after each message (thread, turn, role, text).

    ``asked`` is the MD5 of the last user message; the first version has no parent.  A
    null text has no characters.  Turns are distinct in a thread.
    """
    upto = W.partitionBy("thread").orderBy("turn").rowsBetween(W.unboundedPreceding, W.currentRow)
    n = F.count("*").over(upto).cast("int")
    chars = F.sum(F.coalesce(F.length("text"), F.lit(0))).over(upto)
    asked = F.last(F.when(F.col("role") == "user", F.md5(F.coalesce("text", F.lit("")).cast("binary"))), ignorenulls=True).over(upto)
    rows = messages.select("thread", n.alias("version"), "turn", n.cast("long").alias("messages"), chars.alias("chars"), asked.alias("asked"))
    return rows.select("thread", "version", F.when(F.col("version") > 1, F.col("version") - 1).alias("parent"), "turn", "messages", "chars", "asked")


def version_stream(messages: DataFrame) -> DataFrame:
    """The same on a stream whose threads' messages arrive in order; a micro-batch may hold several."""
    rows = messages.select("thread", "turn", "role", F.coalesce(F.length("text"), F.lit(0)).alias("size"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"))

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        version, chars, asked = state.get if state.exists else (0, 0, None)
        for pdf in batches:  # Spark hands a key's rows over in bounded batches
            pdf = pdf.sort_values("turn")
            numbers = range(version + 1, version + len(pdf) + 1)
            total = chars + pdf["size"].cumsum()
            last = pdf["digest"].where(pdf["role"] == "user").ffill().astype(object)
            last = last.where(last.notna(), asked)
            yield pd.DataFrame({"thread": key[0], "version": numbers, "parent": pd.array([v - 1 if v > 1 else None for v in numbers], "Int32"), "turn": pdf["turn"].to_numpy(), "messages": numbers, "chars": total.to_numpy(), "asked": last.to_numpy()})
            version, chars, asked = version + len(pdf), int(total.iloc[-1]), last.iloc[-1]
        state.update((version, chars, asked))

    out = "thread string, version int, parent int, turn long, messages long, chars long, asked string"
    return rows.groupBy("thread").applyInPandasWithState(fold, out, "version int, chars long, asked string", "append", GroupStateTimeout.NoTimeout)


def save_versions(messages: DataFrame, folder: str, checkpoint: str):
    """Starts the query that appends new versions to a Parquet folder; it reads what there is, then ends."""
    return version_stream(messages).writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def resume_points(saved: DataFrame) -> DataFrame:
    """Each thread's last version, from which it goes on."""
    last = saved.groupBy("thread").agg(F.max(F.struct("version", "turn", "messages", "chars", "asked")).alias("s"))
    return last.select("thread", "s.*")


# --- topics that always end --------------------------------------------------


def closed_topics(events: DataFrame, limit: float, last: str = "done") -> DataFrame:
    """(topic, events, ended, closed_at) from (topic, id, ts, kind): how each topic ends.

    A topic begins with its first event and is over at its first ``last`` event, or ``limit`` seconds after
    its begin where that comes earlier or never; so a lost end leaves no topic open.  Events up to the end count.
    """
    start = F.min("ts").over(W.partitionBy("topic"))
    rows = events.withColumn("deadline", start + F.make_dt_interval(secs=F.lit(limit).cast("decimal(18,6)")))
    done = F.min(F.when((F.col("kind") == last) & (F.col("ts") <= F.col("deadline")), F.struct("ts", "id"))).over(W.partitionBy("topic"))
    rows = rows.withColumn("done", done)
    counts = F.col("done").isNull() & (F.col("ts") <= F.col("deadline")) | (F.struct("ts", "id") <= F.col("done"))
    return rows.groupBy("topic").agg(
        F.count(F.when(counts, 1)).alias("events"),
        F.when(F.max("done").isNull(), "error").otherwise("done").alias("ended"),
        F.coalesce(F.max("done")["ts"], F.max("deadline")).alias("closed_at"),
    )


def closing_stream(events: DataFrame, limit: float, lateness: str, last: str = "done") -> DataFrame:
    """The same on a stream: a row a topic, once the watermark has passed its end.

    Until then the topic's event times are state, those of ``limit`` seconds at most; afterwards only that it is over.
    """
    span = int(round(limit * 1_000_000))
    micros = F.unix_micros("ts")
    rows = events.withWatermark("ts", lateness).select("topic", "ts", F.col("id").alias("id"), micros.alias("at"), (F.col("kind") == last).alias("is_last"))

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        over, at, ids, ends = state.get if state.exists else (False, [], [], [])
        at, ids, ends = list(at), list(ids), list(ends)
        if over:
            return
        for pdf in batches:
            at += pdf["at"].tolist()
            ids += pdf["id"].tolist()
            ends += pdf["is_last"].tolist()
        deadline = min(at) + span
        done = min(((t, i) for t, i, e in zip(at, ids, ends, strict=True) if e and t <= deadline), default=None)
        end = done[0] if done else deadline
        if state.hasTimedOut or end // 1000 < state.getCurrentWatermarkMs():
            n = sum((t, i) <= done if done else t <= deadline for t, i in zip(at, ids, strict=True))
            state.update((True, [], [], []))
            yield pd.DataFrame({"topic": [key[0]], "events": [n], "ended": ["done" if done else "error"], "closed_micros": [end]})
            return
        kept = [(t, i, e) for t, i, e in zip(at, ids, ends, strict=True) if t <= deadline]
        state.update((False, *map(list, zip(*kept, strict=True))))
        state.setTimeoutTimestamp(end // 1000 + 1)

    out = rows.groupBy("topic").applyInPandasWithState(
        fold, "topic long, events long, ended string, closed_micros long", "over boolean, at array<long>, ids array<long>, ends array<boolean>", "append", GroupStateTimeout.EventTimeTimeout
    )
    return out.select("topic", "events", "ended", F.timestamp_micros("closed_micros").alias("closed_at"))
