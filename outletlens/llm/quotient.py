"""Counting quotient filters: lossless, compact counters of whole-number keys, in numpy.

A key of ``bits`` bits (up to 128) is permuted invertibly, so equal keys stay equal, different
keys stay different and all bits are spread. The permuted key's leading bits are its quotient,
the rest its remainder, kept in full. A filter holds its entries in key order: per quotient a
run of remainders (its length in unary bits, about two bits a slot) and per entry a counter of
one byte, longer ones in a list of their own. Sorted filters merge like sorted lists, and the
permutation is undone to read the keys.

Keys are pairs of arrays (low 64 bits, high bits); ``high`` is None where 64 bits do.
"""

from __future__ import annotations

import struct

import numpy as np

from outletlens.llm.hashing import mix

_ODD = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
_LONG = 255                     # a counter byte that stands for an entry of the list of long counters
_u = np.uint64


def _mask(bits: int):
    return _u((1 << bits) - 1)


def _scramble(x: np.ndarray, bits: int) -> np.ndarray:
    """A bijection of numbers of ``bits`` (1 to 64) bits: odd products and folded shifts."""
    shift = _u((bits + 1) // 2)
    for odd in _ODD:
        x = (x * _u(odd)) & _mask(bits)
        x = x ^ (x >> shift) if bits > 1 else x
    return x


def _unscramble(x: np.ndarray, bits: int) -> np.ndarray:
    shift = _u((bits + 1) // 2)
    for odd in reversed(_ODD):
        x = x ^ (x >> shift) if bits > 1 else x
        x = (x * _u(pow(odd, -1, 1 << 64))) & _mask(bits)
    return x


def permute(low, high, bits: int):
    if bits <= 64:
        return _scramble(low, bits), None
    low = _scramble(low, 64)
    high = high ^ (mix(low) & _mask(bits - 64))
    return low ^ mix(~high), high


def unpermute(low, high, bits: int):
    if bits <= 64:
        return _unscramble(low, bits), None
    low = low ^ mix(~high)
    high = high ^ (mix(low) & _mask(bits - 64))
    return _unscramble(low, 64), high


def pack(columns: list, width: int):
    """Keys of word ids below 2**width, the first id in the leading bits."""
    low, high = columns[0].astype(_u), None
    used = width
    for ids in columns[1:]:
        used += width
        if used > 64:
            high = (low >> _u(64 - width)) if high is None else (high << _u(width)) | (low >> _u(64 - width))
        low = (low << _u(width)) | ids.astype(_u)
    return low, high


def unpack(low, high, width: int, n: int) -> np.ndarray:
    """The ids of ``pack`` as rows of n."""
    out = np.empty((len(low), n), np.int64)
    for k in range(n - 1, -1, -1):
        out[:, k] = (low & _mask(width)).astype(np.int64)
        low = low >> _u(width)
        if high is not None:
            low = low | (high << _u(64 - width))
            high = high >> _u(width)
    return out


def count(low, high, counts=None):
    """Sorted distinct keys and their summed counts."""
    if not len(low):
        return low, high, np.zeros(0, np.int64)
    order = np.argsort(low, kind="stable") if high is None else np.lexsort((high, low))
    low, high = low[order], None if high is None else high[order]
    new = np.concatenate(([True], low[1:] != low[:-1]))
    if high is not None:
        new[1:] |= high[1:] != high[:-1]
    first = np.flatnonzero(new)
    if counts is None:
        total = np.diff(np.concatenate((first, [len(low)])))
    else:
        total = np.add.reduceat(counts[order], first)
    return low[first], None if high is None else high[first], total


def merge(parts: list):
    """One filter's entries from those of several: sorted runs are merged, equal keys added up."""
    low = np.concatenate([p[0] for p in parts])
    high = None if parts[0][1] is None else np.concatenate([p[1] for p in parts])
    return count(low, high, np.concatenate([p[2] for p in parts]))


def _bytes(x: np.ndarray, bits: int) -> bytes:
    n = (bits + 7) // 8
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n]).tobytes()


def _numbers(raw: bytes, bits: int, m: int) -> np.ndarray:
    n = (bits + 7) // 8
    out = np.zeros((m, 8), np.uint8)
    out[:, :n] = np.frombuffer(raw, np.uint8, m * n).reshape(m, n)
    return out.reshape(-1).view("<u8").astype(_u)


def split(low, high, counts, bits: int, cut: int):
    """The filters of the 2**cut ranges of leading bits that have entries: (range, entries, bytes)."""
    wide = min(bits, 64)
    rest = wide - cut
    of = (low >> _u(rest)).astype(np.int64) if rest < 64 else np.zeros(len(low), np.int64)
    here, first = np.unique(of, return_index=True)
    for part, a, b in zip(here.tolist(), first.tolist(), [*first.tolist()[1:], len(low)], strict=True):
        m = b - a
        q = min(rest, int(m).bit_length())
        x = low[a:b] & _mask(rest)
        runs = np.bincount((x >> _u(rest - q)).astype(np.int64) if rest > q or q else np.zeros(m, np.int64), minlength=1 << q)
        unary = np.ones(m + (1 << q), np.uint8)
        unary[np.cumsum(runs) + np.arange(1 << q)] = 0
        small = np.where(counts[a:b] < _LONG, counts[a:b], _LONG).astype(np.uint8)
        big = counts[a:b][counts[a:b] >= _LONG]
        yield part, m, b"".join((struct.pack("<qqq", m, q, len(big)), np.packbits(unary).tobytes(), _bytes(x & _mask(rest - q), rest - q),
                                 b"" if high is None else _bytes(high[a:b], bits - 64), small.tobytes(), big.astype("<i8").tobytes()))


def load(part: int, raw: bytes, bits: int, cut: int):
    """The entries of one filter of ``split``."""
    rest = min(bits, 64) - cut
    m, q, longs = struct.unpack_from("<qqq", raw)
    at = 24
    n = (m + (1 << q) + 7) // 8
    unary = np.unpackbits(np.frombuffer(raw, np.uint8, n, at))[:m + (1 << q)]
    at += n
    runs = np.diff(np.flatnonzero(unary == 0), prepend=-1) - 1
    n = m * ((rest - q + 7) // 8)
    low = _numbers(raw[at:at + n], rest - q, m)
    at += n
    low |= np.repeat(np.arange(1 << q).astype(_u), runs) << _u(rest - q) if q else _u(0)
    if cut:
        low |= _u(part) << _u(rest)
    high = None
    if bits > 64:
        n = m * ((bits - 64 + 7) // 8)
        high = _numbers(raw[at:at + n], bits - 64, m)
        at += n
    counts = np.frombuffer(raw, np.uint8, m, at).astype(np.int64)
    counts[counts == _LONG] = np.frombuffer(raw, "<i8", longs, at + m)
    return low, high, counts
