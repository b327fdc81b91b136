"""Vectorised 64-bit hashes of byte substrings, for use inside Arrow tasks."""

from __future__ import annotations

import numpy as np

MULT = np.uint64(0x9E3779B97F4A7C15 | 1)
INV = np.uint64(pow(int(MULT), -1, 1 << 64))
_TABLE = np.random.default_rng(20240607).integers(0, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """MULT**i and MULT**-i modulo 2**64 for i up to n (grown by doubling)."""
    size = 1 << max(16, int(n).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        with np.errstate(over="ignore"):
            both = []
            for base in (MULT, INV):
                p = np.full(size, base, np.uint64)
                p[0] = 1
                both.append(np.multiply.accumulate(p))
        _POWERS[size] = (both[0], both[1])
    return _POWERS[size]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix hashes of a byte array: sums of random byte codes times powers."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_TABLE[data] * up[:len(data)], out=out[1:])
    return out


def slices(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end], equal for equal bytes wherever they stand; the
    length enters too."""
    _, down = powers(len(h))
    with np.errstate(over="ignore"):
        x = (h[end] - h[start]) * down[start]
        return mix(x + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
