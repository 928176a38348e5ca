"""Language identification with bit-sliced Bloom filters over character n-grams.

All languages share one array of slots; bit l of a slot belongs to language l's
filter, so the AND of an n-gram's ``PROBES`` slots is the bitmask of all languages
whose filter contains it. A text's n-grams are counted per language, each count is
corrected for that filter's false positives, and the largest decides.

A language's filter holds the n-grams found in at least ``MIN_SHARE`` of its training
texts, so its size depends on the language and not on the amount of text. Training
reads at most ``TRAIN_TEXTS`` different texts per language in expectation, picked by a
hash of the text (a documented bound on the fitted sample); copies count as one text
throughout. Every text is predicted in whole.

Defined cases: null text or text without a letter gives ``und`` and score 0; with no
training rows every text does; if no n-gram is known, the language with most different
training texts is given with score 0; ties go to the alphabetically first language. Repeated
rows get equal predictions; extra columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outletlens.llm.common import lean, restored, schema_of, scratch, ship, whole
from outletlens.llm.hashing import chunks, mix

SIZES = (2, 3, 4)
SLOTS = 1 << 21
PROBES = 2
MIN_SHARE = 0.1
TRAIN_TEXTS = 6000
UNKNOWN = "und"
#: Characters of text whose n-grams a task holds at once (some 250 bytes of memory each).
_CHUNK = 1 << 17
_letter: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Whether each code point is a letter (one table per worker)."""
    if not _letter:
        _letter.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letter[0]


def _grams(texts: list):
    """For chunks of texts: first text, end text, hashes of all n-grams of lower-cased words
    (one separator on each side, none across words), and the text number of each. Each text
    has a leading and a trailing separator of its own, so its n-grams are the same in any chunk."""
    texts = ["" if t is None else t for t in texts]
    for lo, hi in chunks([len(t) + 2 for t in texts], _CHUNK):
        low = [t.lower() for t in texts[lo:hi]]
        code = np.frombuffer((" " + "  ".join(low) + " ").encode("utf-32-le", "surrogatepass"), "<u4")
        owner = np.repeat(np.arange(len(low)), [len(t) + 2 for t in low])
        letter = _letters()[code]
        value = np.where(letter, code, 0).astype(np.uint64)
        h = np.zeros(len(code), np.uint64)
        inner = np.zeros(len(code), bool)             # a separator lies inside the n-gram
        hashes, owners = [], []
        for n in range(1, max(SIZES) + 1):
            m = len(code) - n + 1
            if m <= 0:
                break
            h = mix(h[:m] + value[n - 1:] + np.uint64(n))
            if n > 2:
                inner = inner[:m] | ~letter[n - 2:n - 2 + m]
            else:
                inner = inner[:m]
            if n in SIZES:
                use = ~inner & (letter[:m] if n == 1 else (letter[:m] | letter[n - 1:])) & (owner[:m] == owner[n - 1:])
                hashes.append(h[:m][use])
                owners.append(owner[n - 1:][use])
        yield lo, hi, np.concatenate(hashes), np.concatenate(owners)


def _slots(h: np.ndarray):
    """PROBES slots of each hash."""
    step = (h >> np.uint64(32)) | np.uint64(1)
    for i in range(PROBES):
        yield ((h + np.uint64(i) * step) & np.uint64(SLOTS - 1)).astype(np.int64)


class Model:
    """Languages (alphabetical), their numbers of different training texts, and the bit-sliced filters
    (slots x words of 64 languages)."""

    def __init__(self, languages: list, texts: list, slots: np.ndarray):
        self.languages, self.texts, self.slots = languages, texts, slots
        bits = [(slots[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1) for i in range(len(languages))]
        #: Probability that an n-gram outside a language is in its filter.
        self.false = np.array([b.mean() ** PROBES for b in bits])

    def counts(self, texts: list):
        """Known n-grams of each text per language, corrected, and all its n-grams."""
        n = len(self.languages)
        hits, total = np.zeros((len(texts), n)), np.zeros(len(texts))
        for lo, hi, h, owner in _grams(texts):
            total[lo:hi] = np.bincount(owner, minlength=hi - lo)
            for w in range(self.slots.shape[1]):
                mask = np.full(len(h), ~np.uint64(0))
                for s in _slots(h):
                    mask &= self.slots[s, w]
                for i in range(64 * w, min(n, 64 * w + 64)):
                    bit = ((mask >> np.uint64(i % 64)) & np.uint64(1)).astype(bool)
                    hits[lo:hi, i] = np.bincount(owner[bit], minlength=hi - lo)
        fixed = np.maximum(0, (hits - self.false * total[:, None]) / np.maximum(1 - self.false, 1e-9))
        return fixed, total

    def predict(self, texts: list) -> pd.DataFrame:
        """lang_pred, score (the winner's share of its and the runner-up's counts), known (share of n-grams it knows)."""
        if not self.languages:
            return pd.DataFrame({"lang_pred": [UNKNOWN] * len(texts), "score": 0.0, "known": 0.0})
        fixed, total = self.counts(texts)
        best = fixed.argmax(axis=1)
        most = fixed[np.arange(len(texts)), best]
        best = np.where(most > 0, best, int(np.argmax(self.texts)))
        second = np.partition(fixed, -2, axis=1)[:, -2] if len(self.languages) > 1 else np.zeros(len(texts))
        score = most / np.maximum(most + second, 1e-9)
        none = total == 0
        names = np.array([*self.languages, UNKNOWN], object)[np.where(none, len(self.languages), best)]
        return pd.DataFrame({"lang_pred": names, "score": np.where(none, 0, score), "known": np.where(none, 0, most / np.maximum(total, 1))})


def fit(docs: DataFrame, train: Column, train_texts: int = TRAIN_TEXTS) -> Model:
    """Learn the filters from text and lang of the rows where ``train`` holds and lang is not null."""
    ship(docs.sparkSession)
    rows = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    # different texts, known by 64-bit hashes
    sizes = {r["lang"]: r["n"] for r in rows.select("lang", F.xxhash64("text")).distinct().groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], [], np.zeros((SLOTS, 1), np.uint64))
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, train_texts / sizes[k]))])
    # equal texts are drawn together and then count once; 2**31 draws
    rows = rows.where(F.pmod(F.xxhash64("text", F.lit("train")), F.lit(1 << 31)) < share[F.col("lang")] * float(1 << 31)).distinct()

    def grams(batches):
        for pdf in batches:
            langs = pdf["lang"].to_numpy()
            for lo, hi, h, owner in _grams(pdf["text"].tolist()):
                # n-grams of each text once, then per language within the chunk
                order = np.lexsort((owner, h))
                h, owner = h[order], owner[order]
                once = np.concatenate(([True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]))) if len(h) else np.zeros(0, bool)
                frame = pd.DataFrame({"lang": langs[lo:hi][owner[once]], "h": h[once].view(np.int64)})
                yield frame.groupby(["lang", "h"], sort=False).size().rename("n").reset_index()
                for name, n in pd.Series(langs[lo:hi]).value_counts().items():
                    yield pd.DataFrame({"lang": [name], "h": [None], "n": [n]})
    found = scratch(rows.mapInPandas(lean(grams), "lang string, h long, n long").groupBy("lang", "h").agg(F.sum("n").alias("n")), "lang-grams")
    drawn = {r["lang"]: r["n"] for r in found.where("h is null").collect()}
    least = F.create_map(*[F.lit(x) for k in languages for x in (k, max(1.0, MIN_SHARE * drawn.get(k, 0)))])
    # at most (mean n-grams of a text) / MIN_SHARE rows for each language, whatever the input's size
    kept = found.where(F.col("h").isNotNull() & (F.col("n") >= least[F.col("lang")])).select("lang", "h").toPandas()
    slots = np.zeros((SLOTS, -(-len(languages) // 64)), np.uint64)
    for i, name in enumerate(languages):
        h = kept["h"].to_numpy()[kept["lang"].to_numpy() == name].astype(np.int64).view(np.uint64)
        for s in _slots(h):
            slots[s, i // 64] |= np.uint64(1) << np.uint64(i % 64)
    return Model(languages, [sizes[k] for k in languages], slots)


def identify(docs: DataFrame, model: Model, keep: list) -> DataFrame:
    """Columns ``keep`` of ``docs`` with lang_pred, score and known."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)      # SLOTS x 8 bytes for each 64 languages
    names = [c for c in keep if c not in ("lang_pred", "score", "known")]

    texts = "text" if "text" in names and dict(docs.dtypes)["text"] == "string" else "_llm_text"     # the text moves once

    def go(batches):
        for pdf in batches:
            found = shared.value.predict(pdf[texts].tolist())
            yield pd.concat([pdf[names].reset_index(drop=True), found], axis=1)
    rows = docs if texts == "text" else docs.select(*names, F.col("text").cast("string").alias(texts))
    rows = whole(rows, list(dict.fromkeys([*names, texts])))
    out = rows.mapInPandas(lean(go), f"{schema_of(docs, names)}, lang_pred string, score double, known double")
    return restored(out, docs, names)
