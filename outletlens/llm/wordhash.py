"""Words of many texts as 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np

from outletlens.llm.hashing import mix, prefix_hash, span_hash

#: Bytes of text that are hashed at once (about 60 bytes of memory each).
CHUNK = 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def kinds(gaps, cuts) -> np.ndarray:
    """Per byte: 0 in a word, 1 between words, 2 between pieces of words."""
    kind = np.zeros(256, np.uint8)
    kind[list(gaps)] = 1
    kind[list(cuts)] = 2
    return kind


def word_chunks(texts: list, kind: np.ndarray):
    """For runs of whole texts (None: empty): (first text, texts, bytes, word starts, word ends,
    hashes, text of each word from 0 in the run, piece of each word). A-Z are lower-cased; every
    text is a piece or more of its own. All separators are below 0x80, so UTF-8 letters stay whole."""
    cut = bytes([int(np.flatnonzero(kind == 2)[0])])
    lo, total, raw = 0, 0, []
    for t in texts:
        more = b"" if t is None else t.encode("utf-8")
        if raw and total + len(more) >= CHUNK:
            yield _words(lo, raw, kind, cut)
            lo, total, raw = lo + len(raw), 0, []
        raw.append(more)
        total += len(more) + 1
    if raw:
        yield _words(lo, raw, kind, cut)


def _words(lo: int, raw: list, kind: np.ndarray, cut: bytes) -> tuple:
    data = _LOWER[np.frombuffer(cut.join(raw) + cut, np.uint8)]
    of = kind[data]
    edge = np.diff(np.concatenate(([0], of == 0, [0])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    size = ends - starts
    hashes = mix(span_hash(prefix_hash(data), starts, size) + size.astype(np.uint64)) if len(starts) else np.zeros(0, np.uint64)
    stops = np.cumsum([len(r) + 1 for r in raw]) - 1
    piece = np.searchsorted(np.flatnonzero(of == 2), starts)
    return lo, len(raw), data, starts, ends, hashes, np.searchsorted(stops, starts), piece
