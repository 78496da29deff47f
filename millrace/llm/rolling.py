"""Running polynomial hashes modulo 2^64 over arrays of numbers."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_CACHE = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of the base and of its inverse."""
    if len(_CACHE[0]) < n:
        size = max(n, len(_CACHE[0]) + len(_CACHE[0]) // 4)
        for k, b in enumerate((BASE, INVERSE)):
            factors = np.full(size, b, np.uint64)
            factors[0] = 1
            with np.errstate(over="ignore"):
                _CACHE[k] = np.cumprod(factors, dtype=np.uint64)
    return _CACHE[0], _CACHE[1]


def running(x: np.ndarray) -> np.ndarray:
    """Hashes of all prefixes, the empty one first."""
    up, _ = powers(len(x) + 1)
    with np.errstate(over="ignore"):
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum((x.astype(np.uint64) + np.uint64(1)) * up[: len(x)], dtype=np.uint64)])


def windows(prefix: np.ndarray, n: int) -> np.ndarray:
    """Hash of every window of ``n`` numbers, as differences of the running
    hash ``prefix``: the work does not depend on ``n``."""
    count = max(0, len(prefix) - n)
    _, down = powers(len(prefix))
    with np.errstate(over="ignore"):
        return (prefix[n : n + count] - prefix[:count]) * down[:count]
