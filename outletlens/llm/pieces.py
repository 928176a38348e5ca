"""SentencePiece encoding and decoding in numpy, batched over equal-length words.

A text is cut before each run of the space mark, which no piece crosses; the distinct
words of a batch are encoded once. Words of equal length advance together: prefix
polynomial hashes give the hash of any substring, which probes the sorted keys of the
pieces, and vectorised extrema choose.

``viterbi`` keeps, for every prefix of a word, the best sum of piece scores and a back
pointer: the segmentation of unigram models. A BPE model's scores are merge ranks, for
which the best sum is not the model's segmentation (on the public 32k model it differs
for 40 % of the words), so ``merge`` replays the merges in the same batches: in each
round every word joins its best-ranked, leftmost pair. ``encode`` takes the one that
fits the model's scores.

Defined cases: null and empty texts have no ids; characters without a piece become
byte pieces; decoding gives the text again, but for the space mark itself (U+2581),
which decodes to a space.
"""

from __future__ import annotations

import heapq
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outletlens.llm.common import id_and_text, lean, long_id, ship
from outletlens.llm.hashing import BASE, chunks, mix

MARK = "▁"
#: Words longer than this are few and of many lengths: their merges run on a heap, one word at a time.
LONG = 64
CACHE_WORDS = 400_000
_CHUNK = 2 << 20
_NONE = np.int64(1) << 62
_unit = re.compile(f"{MARK}+[^{MARK}]*")


def _code(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


class Pieces:
    """Sorted hash keys of the pieces with their ids and scores, and what each id decodes to."""

    def __init__(self, pieces: list, byte_first: int, shown: list):
        """pieces: (id, text, score) of the normal pieces; byte_first: id of byte 0; shown: bytes of every id."""
        self.byte_first = byte_first
        self.longest = max(len(p) for _, p, _ in pieces)
        self.by_text = {p: (i, s) for i, p, s in pieces}
        key = np.array([self._hash(_code(p)) for _, p, _ in pieces], np.uint64)
        order = np.argsort(key)
        self.key = key[order]
        if (self.key[1:] == self.key[:-1]).any():
            raise ValueError("two pieces share a hash")
        self.id = np.array([i for i, _, _ in pieces], np.int64)[order]
        self.score = np.array([s for _, _, s in pieces], float)[order]
        #: The first key of each of 2**16 equal ranges of hashes.
        self.first = np.searchsorted(self.key, np.arange(1 << 16, dtype=np.uint64) << np.uint64(48))
        self.depth = int(np.diff(np.append(self.first, len(key))).max())
        self.key = np.append(self.key, np.zeros(self.depth, np.uint64))
        # merges go by falling score; equal scores merge from left to right
        self.rank = np.unique(-self.score, return_inverse=True)[1].astype(np.int64)
        self.power = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(1 << 10, BASE))))
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.size = np.array([len(s) for s in shown])
        self.start = np.cumsum(self.size) - self.size
        #: BPE scores are the ranks of the merges: whole negative numbers.
        self.bpe = bool((self.score <= 0).all() and (self.score == np.round(self.score)).all())

    @staticmethod
    def _hash(code) -> np.uint64:
        h = 0
        for c in code.tolist():
            h = (h * int(BASE) + c + 1) & 0xFFFFFFFFFFFFFFFF
        return mix(np.array([h], np.uint64))[0]

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash among the sorted keys, or -1."""
        out = np.full(len(h), -1)
        at = self.first[(h >> np.uint64(48)).astype(np.int64)]
        for step in range(self.depth):
            hit = self.key[at + step] == h
            out[hit] = at[hit] + step
        return np.where(out < len(self.id), out, -1)

    def prefixes(self, code: np.ndarray) -> np.ndarray:
        """Prefix hashes of the rows of a matrix of code points."""
        h = np.zeros((code.shape[0], code.shape[1] + 1), np.uint64)
        for i in range(code.shape[1]):
            h[:, i + 1] = h[:, i] * BASE + code[:, i] + np.uint64(1)
        return h

    def spans(self, h, row, lo, hi) -> np.ndarray:
        """Places of the substrings [lo, hi) of the given rows, -1 where there is no piece."""
        return self.find(mix(h[row, hi] - h[row, lo] * self.power[hi - lo]))


def load(path: str) -> Pieces:
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    normal = [(i, sp.id_to_piece(i), sp.get_score(i)) for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
    if any(MARK in p.lstrip(MARK) for _, p, _ in normal):
        raise ValueError("a piece holds a space inside: words cannot be encoded one by one")
    first = next(i for i in range(n) if sp.is_byte(i))
    shown = [bytes([i - first]) if sp.is_byte(i) else b"" if sp.is_control(i) else sp.id_to_piece(i).replace(MARK, " ").encode() for i in range(n)]
    return Pieces(normal, first, shown)


def viterbi(p: Pieces, code: np.ndarray) -> np.ndarray:
    """Ends of the best-scored segmentation of equal-length words: a matrix marking, for
    each word (row), the places where a piece ends. A character without a piece costs more
    than any piece; ties go to the longest last piece."""
    rows, n = code.shape
    h, every = p.prefixes(code), np.arange(rows)
    lone = p.score.min() - 10
    best, back = np.full((rows, n + 1), -np.inf), np.zeros((rows, n + 1), np.int64)
    best[:, 0] = 0
    for j in range(1, n + 1):
        lo = np.arange(max(0, j - p.longest), j)
        at = p.spans(h, np.repeat(every, len(lo)), np.tile(lo, rows), np.full(rows * len(lo), j)).reshape(rows, -1)
        gain = np.where(at >= 0, p.score[np.maximum(at, 0)], -np.inf)
        gain[:, -1] = np.where(at[:, -1] >= 0, gain[:, -1], lone)
        total = best[:, lo] + gain
        k = total.argmax(axis=1)
        best[:, j], back[:, j] = total[every, k], lo[k]
    ends, at = np.zeros((rows, n + 1), bool), np.full(rows, n)
    while (at > 0).any():
        ends[every, at] = True
        at = back[every, at]
    return ends[:, 1:]


def merge(p: Pieces, code: np.ndarray) -> np.ndarray:
    """Like ``viterbi``, by the merges of a BPE model."""
    rows, n = code.shape
    h = p.prefixes(code)
    end = np.tile(np.arange(1, n + 2), (rows, 1))        # of the symbol that starts here
    prev = np.tile(np.arange(-1, n), (rows, 1))          # start of the symbol before it
    rank = np.full((rows, n + 1), _NONE)                 # of joining the symbol here and the next

    def joined(r, lo, hi):
        at = p.spans(h, r, lo, hi)
        return np.where((at >= 0) & (hi - lo <= p.longest), p.rank[np.maximum(at, 0)], _NONE)
    if n > 1:
        r, i = np.repeat(np.arange(rows), n - 1), np.tile(np.arange(n - 1), rows)
        rank[r, i] = joined(r, i, i + 2)
    live = np.arange(rows)
    while len(live):
        a = rank[live].argmin(axis=1)
        more = rank[live, a] < _NONE
        live, a = live[more], a[more]
        b = end[live, a]
        c = end[live, b]
        end[live, a] = c
        end[live, b] = 0
        rank[live, b] = _NONE
        prev[live, c] = a
        rank[live, a] = _NONE
        k = np.flatnonzero(c < n)
        rank[live[k], a[k]] = joined(live[k], a[k], end[live[k], c[k]])
        before = prev[live, a]
        k = np.flatnonzero(before >= 0)
        rank[live[k], before[k]] = joined(live[k], before[k], c[k])
    ends = np.zeros((rows, n + 1), bool)
    start = end[:, :n] > 0
    r = np.nonzero(start)[0]
    ends[r, end[:, :n][start]] = True
    return ends[:, 1:]


def _merge_long(p: Pieces, word: str) -> np.ndarray:
    """Ends of one long word's pieces, by a heap of pairs."""
    n = len(word)
    end, prev = list(range(1, n + 1)), list(range(-1, n))
    heap: list = []

    def push(a):
        b = end[a]
        if b < n and end[b] - a <= p.longest:
            piece = p.by_text.get(word[a:end[b]])
            if piece is not None:
                heapq.heappush(heap, (-piece[1], a, b, end[b]))
    for i in range(n - 1):
        push(i)
    while heap:
        _, a, b, c = heapq.heappop(heap)
        if end[a] != b or b >= n or end[b] != c:
            continue
        end[a], end[b] = c, 0
        if c < n:
            prev[c] = a
        push(a)
        if prev[a] >= 0:
            push(prev[a])
    out = np.zeros(n, bool)
    out[[e - 1 for e in end if e > 0]] = True
    return out


class Encoder:
    """Ids of texts, through a cache of words."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.cache: dict[str, bytes] = {}

    def _ids(self, words: list, code: np.ndarray, ends: np.ndarray) -> None:
        """Put the ids of equal-length words, cut at ``ends``, into the cache."""
        p = self.pieces
        h = p.prefixes(code)
        row, last = np.nonzero(ends)
        first = np.concatenate(([0], last[:-1] + 1))
        first[np.concatenate(([True], row[1:] != row[:-1]))] = 0
        at = p.spans(h, row, first, last + 1)
        ids = np.where(at >= 0, p.id[np.maximum(at, 0)], -1)
        cut = np.searchsorted(row, np.arange(len(words) + 1))
        raw, lone = ids.astype("<u4").tobytes(), np.unique(row[at < 0])
        for i, w in enumerate(words):
            self.cache[w] = raw[4 * cut[i]:4 * cut[i + 1]]
        for i in lone.tolist():               # characters without a piece: their bytes
            out = []
            for k in range(cut[i], cut[i + 1]):
                out += [p.byte_first + b for b in words[i][first[k]].encode("utf-8", "surrogatepass")] if ids[k] < 0 else [int(ids[k])]
            self.cache[words[i]] = np.array(out, "<u4").tobytes()

    def learn(self, words: list) -> None:
        """Encode words that the cache lacks, in groups of equal length."""
        p = self.pieces
        method = merge if p.bpe else viterbi
        words.sort(key=len)
        sizes = np.array([len(w) for w in words])
        for n in np.unique(sizes).tolist():
            same = words[np.searchsorted(sizes, n):np.searchsorted(sizes, n, "right")]
            step = max(1, 300_000 // n)
            for lo in range(0, len(same), step):
                part = same[lo:lo + step]
                code = _code("".join(part)).reshape(len(part), n)
                if n + 1 > len(p.power):
                    p.power = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(2 * n, BASE))))
                if p.bpe and n > LONG:
                    ends = np.stack([_merge_long(p, w) for w in part])
                else:
                    ends = method(p, code)
                self._ids(part, code, ends)

    def encode(self, texts: list) -> list:
        """Ids of each text as little-endian unsigned 32-bit bytes."""
        words = []
        for t in texts:
            if not t:
                words.append([])
            elif "  " in t or MARK in t or t[0] == " " or t[-1] == " ":
                words.append(_unit.findall(MARK + t.replace(" ", MARK)))
            else:
                words.append([MARK + w for w in t.split(" ")])
        if len(self.cache) > CACHE_WORDS:
            self.cache = {}
        self.learn(list(set().union(*words).difference(self.cache)))
        return [b"".join(map(self.cache.__getitem__, w)) for w in words]


def decode(p: Pieces, ids: bytes) -> str:
    """The text of ids (as little-endian unsigned 32-bit bytes)."""
    i = np.frombuffer(ids, "<u4").astype(np.int64)
    size = p.size[i]
    at = np.repeat(p.start[i], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    text = p.shown[at].tobytes().decode("utf-8", "replace")
    return text[1:] if text[:1] == " " else text


_encoders: dict[str, Encoder] = {}


def _encoder(name: str, pieces: Pieces) -> Encoder:
    if name not in _encoders:
        _encoders[name] = Encoder(pieces)
    return _encoders[name]


def encode_column(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with llm_ids, the ids of text (array of int; null text: empty)."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(load(path))     # a fixed public vocabulary

    @F.pandas_udf("array<int>")
    def run(text: pd.Series) -> pd.Series:
        enc = _encoder(path, shared.value)
        out = []
        for lo, hi in chunks([len(t or "") for t in text], _CHUNK):
            out += [np.frombuffer(b, "<i4") for b in enc.encode(text.iloc[lo:hi].tolist())]
        return pd.Series(out, index=text.index, dtype=object)
    return docs.withColumn("llm_ids", run(F.col("text").cast("string")))


def encode_digest(docs: DataFrame, path: str) -> DataFrame:
    """Per row: doc_id, n_tokens, n_byte_tokens, ids_crc32, round_trip (decoding gives the text again)."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(load(path))

    def run(batches):
        p = shared.value
        enc = _encoder(path, p)
        for pdf in batches:
            texts, rows = [t or "" for t in pdf["text"].tolist()], []
            for lo, hi in chunks([len(t) for t in texts], _CHUNK):
                for t, raw in zip(texts[lo:hi], enc.encode(texts[lo:hi]), strict=True):
                    i = np.frombuffer(raw, "<u4")
                    rows.append((len(i), int(((i >= p.byte_first) & (i < p.byte_first + 256)).sum()), zlib.crc32(raw),
                                 decode(p, raw) == t.replace(MARK, " ")))
            yield pd.concat([pdf["doc_id"].reset_index(drop=True), pd.DataFrame(rows, columns=["n_tokens", "n_byte_tokens", "ids_crc32", "round_trip"])], axis=1)
    return long_id(id_and_text(docs).mapInPandas(
        lean(run), "doc_id string, n_tokens long, n_byte_tokens long, ids_crc32 long, round_trip boolean"))
