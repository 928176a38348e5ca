"""Prefix polynomial hashes over byte buffers, modulo 2**64, in numpy."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C17)      # odd, and (BASE - 1) / 2 is odd: few bits are lost
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: 64-bit value of each byte.
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE**i (or its modular inverse) for i from 0 to n."""
    key = "inverse" if inverse else "base"
    if key not in _powers or len(_powers[key]) <= n:
        p = np.full(max(n + 1, 1 << 16), _INVERSE if inverse else BASE, np.uint64)
        p[0] = 1
        _powers[key] = np.multiply.accumulate(p)
    return _powers[key]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with H[i + 1] = H[i] * BASE + value(data[i]); H[0] = 0."""
    n = len(data)
    h = np.zeros(n + 1, np.uint64)
    if n:
        inv, pos = powers(n, True), powers(n)
        np.cumsum(_BYTE[data] * inv[:n], out=h[1:])
        h[1:] *= pos[:n]
    return h


def prefix_values(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The bytes' values times BASE**-at: their running sum times BASE**(at) is a prefix hash."""
    return _BYTE[data] * powers(int(at.max(initial=0)), True)[at]


def span_hash(h: np.ndarray, start: np.ndarray, length) -> np.ndarray:
    """Hash of data[start : start + length] from its prefix hashes."""
    p = powers(int(np.max(length, initial=0)) if not np.isscalar(length) else length)
    return h[start + length] - h[start] * p[length]


def chunks(sizes, most: int):
    """Index ranges of consecutive items whose sizes sum to at most ``most`` (one item at least)."""
    lo, total = 0, 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > most:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)
