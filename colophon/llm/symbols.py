"""Texts as arrays of 64 symbols: 0 for what is no letter, 1-26 for a-z, 27-63 for all other letters.

Other letters are spread over 37 symbols by a hash of their lower case, so any
script keeps most of its contrast while every table over n symbols stays bounded
by 64**n.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

SIZE = 64
#: Characters that one round of array work handles, about.
CHUNK = 1 << 20


def _symbol(cp: int) -> int:
    c = chr(cp)
    if not c.isalpha():
        return 0
    low = c.lower()[0]
    if "a" <= low <= "z":
        return ord(low) - 96
    return 27 + (ord(low) * 2654435761 & 0xFFFFFFFF) % 37


@lru_cache(maxsize=1)
def _plane() -> np.ndarray:
    return np.array([_symbol(cp) for cp in range(0x10000)], np.uint8)


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def symbols(cps: np.ndarray) -> np.ndarray:
    high = cps > 0xFFFF
    if not high.any():
        return _plane()[cps]
    out = _plane()[np.where(high, 0, cps)]
    values, back = np.unique(cps[high], return_inverse=True)
    out[high] = np.array([_symbol(int(v)) for v in values], np.uint8)[back]
    return out


def chunks(rows: Iterator[tuple]) -> Iterator[tuple[list[tuple], np.ndarray, np.ndarray]]:
    """Groups (..., text) rows of about CHUNK characters: (rows, code points, row of each).

    Texts stand one after the other, each followed by one blank.  A text longer
    than CHUNK is a group of its own.
    """
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size >= CHUNK:
            yield joined(held)
            held, size = [], 0
    if held:
        yield joined(held)


def joined(rows: list[tuple]) -> tuple[list[tuple], np.ndarray, np.ndarray]:
    cps = points(" ".join(r[-1] for r in rows) + " ")
    return rows, cps, np.repeat(np.arange(len(rows), dtype=np.int32), [len(r[-1]) + 1 for r in rows])
