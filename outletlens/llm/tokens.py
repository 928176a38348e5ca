"""Token ids of whole texts with a public tokenizer, through a cache of words."""

from __future__ import annotations

import os
import re

import numpy as np

from outletlens.llm.hashing import mix, prefix_hash, span_hash

#: Words that a worker keeps with their ids (some 30 bytes each); a full cache is emptied and filled anew.
CACHE_WORDS = 3_000_000
#: Parts of words that it keeps (some 200 bytes each).
CACHE_PARTS = 200_000
_BATCH = 10_000
#: Words of these characters only are in normal form and lower-cased alike everywhere.
_plain = re.compile("[!-~À-ÖØ-öø-ÿ]+")
#: The tokenizer's own split of lower-cased text, for such words.
_part = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


class WordEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    The tokenizer drops white space and never joins across it, so a text's ids are
    its words' ids one after another, and each distinct word is encoded once per fill of
    the cache. Only the space and line feed part words here; other white space stays
    inside and is left to the tokenizer. Words of plain characters are the ids of their
    parts (letters, digits, signs) one after another, which differ much less than the words.

    Words are known by 64-bit hashes: a batch's words are hashed, looked up and turned
    into ids as arrays. (Two of a million words share a hash once in some 10**7 caches.)"""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer = Tokenizer.from_str(spec)
        #: The same vocabulary and merges for parts, which are normal, lower-cased and split already.
        self.by_part = Tokenizer.from_str(spec)
        self.by_part.normalizer = None
        self.by_part.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        #: Whether an id is the last one of a part.
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.parts: dict[str, bytes] = {}
        self._empty()

    def _encode_parts(self, parts: list) -> None:
        """Encode distinct parts, many in one text: parted by spaces they stay apart, and
        a part's last id says so."""
        for lo in range(0, len(parts), _BATCH):
            some = parts[lo:lo + _BATCH]
            texts = [" ".join(some[i:i + 1000]) for i in range(0, len(some), 1000)]
            ids = np.concatenate([np.array(e.ids, "<u4") for e in self.by_part.encode_batch_fast(texts, add_special_tokens=False)])
            cut = np.concatenate(([0], 4 * (np.flatnonzero(self.last[ids]) + 1)))
            if len(cut) == len(some) + 1:
                raw = ids.tobytes()
                for p, a, b in zip(some, cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                    self.parts[p] = raw[a:b]
            else:
                self._encode_each(some, self.parts)

    def _encode_each(self, words: list, into: dict) -> None:
        for lo in range(0, len(words), _BATCH):
            some = words[lo:lo + _BATCH]
            for w, e in zip(some, self.tokenizer.encode_batch(some, add_special_tokens=False), strict=True):
                into[w] = np.array(e.ids, "<u4").tobytes()

    def _ids(self, new: list) -> list:
        """Ids of distinct words, as bytes."""
        plain = {w: _part.findall(w.lower()) for w in new if _plain.fullmatch(w) and "<|" not in w}
        if len(self.parts) > CACHE_PARTS:
            self.parts = {}
        self._encode_parts(list(set().union(*plain.values()).difference(self.parts)))
        ids, other = self.parts.__getitem__, {}
        self._encode_each([w for w in new if w not in plain], other)
        return [b"".join(map(ids, plain[w])) if w in plain else other[w] for w in new]

    def _empty(self) -> None:
        #: Sorted hashes of the words, and where their ids stand in the pool.
        self.known, self.first, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, "<u4")

    def _learn(self, hashes: np.ndarray, raw: list) -> None:
        found = [np.frombuffer(b, "<u4") for b in self._ids([w.decode("utf-8", "surrogatepass") for w in raw])]
        size = np.array([len(f) for f in found])
        known = np.concatenate((self.known, hashes))
        order = np.argsort(known, kind="stable")       # two sorted runs: a merge
        self.known = known[order]
        self.first = np.concatenate((self.first, len(self.pool) + np.cumsum(size) - size))[order]
        self.size = np.concatenate((self.size, size))[order]
        self.pool = np.concatenate((self.pool, *found))

    def encode(self, texts: list) -> list:
        if len(self.known) > CACHE_WORDS:
            self._empty()
        part = [t.encode("utf-8", "surrogatepass") for t in texts]
        raw = b" ".join(part) + b" "
        data = np.frombuffer(raw, np.uint8)
        ends = np.flatnonzero((data == 32) | (data == 10))
        starts = np.concatenate(([0], ends[:-1] + 1))
        full = ends > starts
        starts, ends = starts[full], ends[full]
        if not len(starts):
            return [b""] * len(texts)
        h = mix(span_hash(prefix_hash(data), starts, ends - starts) + (ends - starts).astype(np.uint64))
        distinct, at, word = np.unique(h, return_index=True, return_inverse=True)
        place = np.searchsorted(self.known, distinct)
        here = place < len(self.known)
        here[here] = self.known[place[here]] == distinct[here]
        if not here.all():
            new = at[~here]
            self._learn(distinct[~here], [raw[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
            place = np.searchsorted(self.known, distinct)
        size = self.size[place][word]
        stop = np.cumsum(size)
        ids = self.pool[np.repeat(self.first[place][word] - stop + size, size) + np.arange(stop[-1])].tobytes()
        edge = np.searchsorted(starts, np.cumsum([len(p) + 1 for p in part]))     # words before each text's end
        cut = np.concatenate(([0], 4 * np.concatenate(([0], stop))[edge])).tolist()
        return [ids[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


_encoders: dict[int, WordEncoder] = {}


def encoder(spec: str) -> WordEncoder:
    """One encoder per worker and tokenizer."""
    key = hash(spec)
    if key not in _encoders:
        _encoders[key] = WordEncoder(spec)
    return _encoders[key]
