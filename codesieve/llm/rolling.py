"""Polynomial hashes of all substrings of a text, modulo 2^64, from one array of prefix sums."""

from __future__ import annotations

import numpy as np

STEP = 0x9E3779B97F4A7C15
BYTE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def powers(n: int) -> list[np.ndarray]:
    """Powers of STEP and of its inverse."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        _powers[:] = [np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, np.uint64(base))])) for base in (STEP, pow(STEP, -1, 2**64))]
    return _powers


def prefix_sums(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, down): (sums[j] - sums[i]) * down[i] is the hash of bytes i to j wherever they stand."""
    up, down = powers(len(x) + 1)
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(BYTE[x] * up[: len(x)], out=sums[1:])
    return sums, down


def mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h
