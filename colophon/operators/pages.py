"""Regions of sorted pages: the boxes of one page are paired and joined by arrays, many pages at a time.

For pages of bounded length only; :mod:`colophon.operators.regions` sends fuller ones through the grid
and :mod:`colophon.operators.figures` cuts them into bands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pairs of boxes that one array operation holds.
PAIRS = 1 << 20


def _changes(column: pa.ChunkedArray) -> np.ndarray:
    """For each row but the first whether the value differs from the row's before."""
    if pa.types.is_struct(column.type):
        return np.logical_or.reduce([_changes(c) for c in column.flatten()])
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    differ = pc.coalesce(pc.not_equal(a, b), pc.xor(a.is_null(), b.is_null()))
    return differ.to_numpy()


def whole_pages(batches: Iterator[pa.RecordBatch], page: str) -> Iterator[pa.Table]:
    """Tables of rows sorted by page, cut between pages only."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        new = pa.Table.from_batches([b])
        held = new if held is None else pa.concat_tables([held, new]).combine_chunks()
        ends = np.flatnonzero(_changes(held.column(page)))
        if len(ends):
            yield held.slice(0, ends[-1] + 1)
            held = held.slice(ends[-1] + 1)
    if held is not None:
        yield held


def _labels(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Each row's least row among those that pairs connect it with."""
    label = np.arange(n)
    while True:
        a, b = label[u], label[v]
        open_ = a != b
        if not open_.any():
            return label
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]


def _numbers(table: pa.Table, column: str) -> np.ndarray:
    return pc.fill_null(pc.cast(table.column(column), pa.float64()), np.nan).to_numpy()


def _fans(fan: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, place): each i as often as ``fan`` says with its places from 0, PAIRS of them at a time and no i cut."""
    total = np.concatenate([[0], np.cumsum(fan)])
    lo = 0
    while lo < len(fan):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + PAIRS, "right")) - 1)
        i = np.repeat(np.arange(lo, hi), fan[lo:hi])
        yield i, np.arange(len(i)) - (total[i] - total[lo])
        lo = hi


def _neighbours(box: list[np.ndarray], ends: np.ndarray, across: float, down: float, common: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one page whose boxes are adjacent, the lower row first."""
    x0, y0, x1, y1 = box
    proper = (x0 <= x1) & (y0 <= y1)
    found = []
    for u, place in _fans(ends - np.arange(len(ends)) - 1):
        v = u + 1 + place
        ok = proper[u] & proper[v]
        u, v = u[ok], v[ok]
        apart = lambda p, q: np.maximum(0.0, np.maximum(p[u] - q[v], p[v] - q[u]))
        shared = lambda p, q: np.minimum(q[u], q[v]) - np.maximum(p[u], p[v])
        ok = ((apart(y0, y1) <= down) & (shared(x0, x1) > common)) | ((apart(x0, x1) <= across) & (shared(y0, y1) > common))
        found.append((u[ok], v[ok]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def joined(table: pa.Table, across: float, down: float, common: float) -> tuple[np.ndarray, np.ndarray]:
    """For rows (page, id, number, x0, y0, x1, y1) sorted by page and id: the row that names each row's region, and the row that gives its number."""
    n = table.num_rows
    turns = np.flatnonzero(_changes(table.column("page"))) + 1
    ends = np.repeat(np.append(turns, n), np.diff(np.concatenate([[0], turns, [n]])))
    box = [_numbers(table, c) for c in ("x0", "y0", "x1", "y1")]
    u, v = _neighbours(box, ends, across, down, common)
    again = np.flatnonzero(~_changes(table.column("id"))) + 1  # rows of one id are one box
    again = again[again < ends[again - 1]]
    u, v = np.concatenate([u, again - 1]), np.concatenate([v, again])
    code = pc.fill_null(table.column("number").combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
    loose, given = code < 0, np.arange(n)
    # groups without a number take that of the first numbered box beside them
    both = loose[u] & loose[v]
    group = _labels(n, u[both], v[both])
    mixed = loose[u] != loose[v]
    side, giver = np.where(loose[u], u, v)[mixed], np.where(loose[u], v, u)[mixed]
    order = np.lexsort((giver, box[0][giver], box[1][giver], group[side]))
    at, first = np.unique(group[side][order], return_index=True)
    named = np.full(n, -1)
    named[at] = giver[order][first]
    taken = loose & (named[group] >= 0)
    given[taken] = named[group][taken]
    code = code[given]
    same = code[u] == code[v]
    return _labels(n, u[same], v[same]), given


def absorbed(table: pa.Table, caption: str, gap: float) -> dict[str, np.ndarray]:
    """For the captions among rows (page, x0, y0, x1, y1, upper) sorted by page with graphics first: n, top, bottom, left and right of what each absorbs, and any_above.

    The boolean column ``caption`` tells captions from graphics; values of captions that absorb nothing are NaN.
    """
    is_cap = table.column(caption).to_numpy()
    turns = np.concatenate([[0], np.flatnonzero(_changes(table.column("page"))) + 1])
    caps = np.flatnonzero(is_cap)
    begin = turns[np.searchsorted(turns, caps, "right") - 1]
    graphics = np.add.reduceat(~is_cap, turns, dtype=np.int64)[np.searchsorted(turns, caps, "right") - 1]
    x0, y0, x1, y1 = (_numbers(table, c) for c in ("x0", "y0", "x1", "y1"))
    ceiling, floor = y0[caps] - 2, np.fmax(0.0, _numbers(table, "upper")[caps])
    out = {"n": np.zeros(len(caps), np.int64), "any_above": np.zeros(len(caps), bool)}
    out |= {c: np.full(len(caps), np.nan) for c in ("top", "bottom", "left", "right")}
    for c, place in _fans(graphics):
        g = begin[c] + place
        ok = (y0[g] < ceiling[c]) & (y1[g] > floor[c])
        c, g = c[ok], g[ok]
        out["any_above"][c] = True
        order = np.lexsort((y0[g], -y1[g], c))
        c, g = c[order], g[order]
        first = np.append(True, c[1:] != c[:-1])[: len(c)]
        # the highest edge of those before: ranks fall from caption to caption, so a running minimum starts anew with each
        edges, rank = np.unique(y0[g], return_inverse=True)
        shift = -c * len(edges)
        before = np.roll(np.minimum.accumulate(rank + shift), 1) - shift
        before = np.where(first, ceiling[c], edges[np.where(first, 0, before)] if len(c) else 0.0)
        stops = np.cumsum(before - y1[g] > gap)
        held = stops - np.repeat((stops - (before - y1[g] > gap))[first], np.diff(np.append(np.flatnonzero(first), len(c)))) == 0
        c, g = c[held], g[held]
        at = np.flatnonzero(np.append(True, c[1:] != c[:-1])[: len(c)])
        if len(at):
            out["n"][c[at]] = np.diff(np.append(at, len(c)))
            for name, f, v in (("top", np.minimum, y0), ("bottom", np.maximum, y1), ("left", np.fmin, x0), ("right", np.fmax, x1)):
                out[name][c[at]] = f.reduceat(v[g], at)
    return out
