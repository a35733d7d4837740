"""A job's state from its events, on batch tables and on streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from colophon.operators.folds import sorted_fold

#: Stages of a job and the progress they show; a job ends as done or failed.
STAGES = ("pending", "downloading", "parsing", "done")
PROGRESS = {"pending": 0, "downloading": 10, "parsing": 50, "done": 100}
TERMINAL = ("done", "failed")


def step(status: str, progress: int, action: str | None) -> tuple[str, int]:
    """advance and fail touch only running jobs, retry only ended ones, reset sends a running job back."""
    if status in TERMINAL:
        return ("pending", 0) if action == "retry" else (status, progress)
    if action == "advance":
        status = STAGES[STAGES.index(status) + 1]
        return status, PROGRESS[status]
    if action == "fail":
        return "failed", progress
    return ("pending", 0) if action == "reset" else (status, progress)


def job_states(events: DataFrame) -> DataFrame:
    """(job, status, progress, events) from (job, seq, action); null actions change nothing."""

    def fold(state, row):
        status, progress = step(*(state or ("pending", 0)), row.action)
        return (status, progress), f"{status}:{progress}"

    steps = sorted_fold(events.select("job", "seq", "action"), "job", ["seq"], fold, "state", "string")
    last = steps.groupBy("job").agg(F.max_by("state", "seq").alias("state"), F.count("*").alias("events"))
    part = F.split("state", ":")
    return last.select("job", part[0].alias("status"), part[1].cast("int").alias("progress"), "events")


def job_stream(events: DataFrame) -> DataFrame:
    """The same on a stream: one row a job and micro-batch, with the state after it."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, progress, n = state.get if state.exists else ("pending", 0, 0)
        rows = pd.concat(list(batches)).sort_values("seq")  # one micro-batch of one job
        for action in rows["action"]:
            status, progress = step(status, progress, action)
        state.update((status, progress, n + len(rows)))
        yield pd.DataFrame({"job": [key[0]], "status": [status], "progress": [progress], "events": [n + len(rows)]})

    return events.groupBy("job").applyInPandasWithState(
        fold, "job long, status string, progress int, events long", "status string, progress int, events long", "update", GroupStateTimeout.NoTimeout
    )
