"""Polynomial hashes of byte strings, 64-bit, vectorised."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Odd, so it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def byte_table() -> np.ndarray:
    """A random odd number for each byte."""
    return np.random.default_rng(8).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(maxsize=4)
def _powers(n: int, inverse: bool) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = np.uint64(pow(BASE, -1, 1 << 64) if inverse else BASE)
    return np.multiply.accumulate(out)


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first ``n`` powers of BASE, or of its inverse; tables come in powers of two, so few are kept."""
    return _powers(1 << max(16, (n - 1).bit_length()), inverse)[:n]


def prefix_sums(raw: np.ndarray) -> np.ndarray:
    """Sums from which ``range_hashes`` takes the hash of any range of ``raw``."""
    return np.append(np.uint64(0), np.cumsum(byte_table()[raw] * powers(len(raw)))) if len(raw) else np.zeros(1, np.uint64)


def range_hashes(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each range, the same wherever the bytes stand (not mixed)."""
    return (sums[stop] - sums[start]) * powers(len(sums), True)[start]
