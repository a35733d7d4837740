"""Exact integer matrix products from float32 products in a residue number system.

Both matrices are reduced modulo small primes to residues of least absolute
value; a float32 product of them is exact while no partial sum reaches 2**24, so
long rows are multiplied in runs of columns that keep below it.  As many primes
are used as the product's bound needs, and Garner's mixed-radix form of the
Chinese remainder theorem puts the signed entries together.
"""

from __future__ import annotations

import numpy as np

LOW, HIGH = -(1 << 63) + 1, (1 << 63) - 1
#: Odd primes below 2**7, largest first: residues of at most 63 leave room for 4,227 columns in one float32 product.
PRIMES = [p for p in range(127, 2, -1) if all(p % k for k in range(2, p))]
EXACT = 1 << 24


def primes_for(bound: float) -> list[int]:
    """Primes whose product exceeds 2 * bound + 1, where |entry| <= bound."""
    need, out, product = 2 * int(bound * (1 + 1e-9)) + 3, [], 1
    for p in PRIMES:
        if product > need:
            break
        out.append(p)
        product *= p
    if product <= need:
        raise ValueError("entries are beyond the residue system")
    return out


def residues(x: np.ndarray, p: int) -> np.ndarray:
    """float32 residues of least absolute value of an int64 matrix."""
    r = x % p
    return np.where(r > p // 2, r - p, r).astype(np.float32)


def product_mod(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """(a @ b.T) mod p, in 0 .. p - 1, for residue matrices."""
    run = EXACT // (p // 2) ** 2
    out = np.zeros((len(a), len(b)), np.int64)
    for k in range(0, a.shape[1], run):
        out += (a[:, k : k + run] @ b[:, k : k + run].T).astype(np.int64)
        out %= p
    return out


def joined(parts: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Signed entries from their residues; beyond long they are set to its nearest end."""
    digits: list[np.ndarray] = []
    for i, p in enumerate(primes):
        known, weight = np.zeros_like(parts[0]), 1
        for d, q in zip(digits, primes, strict=False):
            known = (known + d * weight) % p
            weight = weight * q % p
        digits.append((parts[i] - known) * pow(weight, -1, p) % p)
    whole, wide = 1, np.prod([float(p) for p in primes]) >= 2.0**62
    total = np.zeros(parts[0].shape, object if wide else np.int64)
    for d, p in zip(digits, primes, strict=True):
        total = total + (d.astype(object) if wide else d) * whole
        whole *= p
    total = np.where(total > whole // 2, total - whole, total)
    return np.clip(total, LOW, HIGH).astype(np.int64) if wide else total


class Side:
    """One matrix with its residues, taken once for all products."""

    def __init__(self, x: np.ndarray, primes: list[int]):
        self.primes, self.parts = primes, [residues(x, p) for p in primes]

    def times(self, other: Side, lo: int, hi: int) -> np.ndarray:
        """Rows lo to hi of this matrix times the other's transpose."""
        return joined([product_mod(a[lo:hi], b, p) for a, b, p in zip(self.parts, other.parts, self.primes, strict=True)], self.primes)
