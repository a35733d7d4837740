"""Order-dependent folds over sorted rows, for rules that no window function can express.

A key's rows stream through one task in order and only a small state is held, so
a key of any length needs no more memory than one Arrow batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def sorted_fold(rows: DataFrame, key: str, order: list[str], step: Callable, out: str, kind: str) -> DataFrame:
    """Adds the column ``out`` of type ``kind``.

    ``step(state, row)`` returns (state, value); state is None at a key's first
    row.  Rows are namedtuples of ``rows``.  Null keys form one group.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != out) + f", `{out}` {kind}"

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, current, begun = None, None, False
        for pdf in batches:
            values = []
            for row in pdf.itertuples(index=False):
                k = getattr(row, key)
                k = None if pd.isna(k) else k
                if not begun or k != current:
                    state, current, begun = None, k, True
                state, value = step(state, row)
                values.append(value)
            yield pdf.assign(**{out: values})

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(work, schema)


def merge_pieces(pieces: DataFrame, key: str, order: list[str], label: str, size: str, budget: int) -> DataFrame:
    """Adds ``unit``: neighbours of one label share a unit while their sizes and a joint each stay in the budget."""

    def step(state, row):
        lab, n = getattr(row, label), getattr(row, size)
        if state and state[1] == lab and state[2] + n + 1 <= budget:
            state = (state[0], lab, state[2] + n + 1)
        else:
            state = (state[0] + 1 if state else 0, lab, n)
        return state, state[0]

    return sorted_fold(pieces, key, order, step, "unit", "int")


def fill_budget(chunks: DataFrame, key: str, order: list[str], size: str, budget: int) -> DataFrame:
    """Adds ``taken``: in order, each chunk that still fits is taken; one too large is skipped."""

    def step(state, row):
        used, n = state or 0, getattr(row, size)
        fits = used + n <= budget
        return (used + n if fits else used), bool(fits)

    return sorted_fold(chunks, key, order, step, "taken", "boolean")


def drop_nearby(marks: DataFrame, key: str, order: list[str], at: str, gap: float) -> DataFrame:
    """Adds ``stays``: a mark stays where it is at least ``gap`` from the last that stayed."""

    def step(state, row):
        x = getattr(row, at)
        if state is not None and abs(x - state) < gap:
            return state, False
        return x, True

    return sorted_fold(marks, key, order, step, "stays", "boolean")
