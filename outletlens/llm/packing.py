"""Best-fit packing of documents into token sequences by the sum-of-squares rule.

Each piece goes where the sum over all residual gaps of the squared number of open
sequences with that gap becomes smallest; pieces come in order of falling length, so
that the short ones fill the gaps the long ones leave. Pieces are dealt at random into
groups of about ``GROUP_SEQUENCES`` full sequences, each packed by itself: a group leaves
a few sequences part full, which is a fixed small share of it at any input size.

Defined cases: a null or empty text is one piece that holds the end id alone; repeated
rows are packed as often as they occur; an empty table gives no rows; extra columns are
not looked at.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outletlens.llm.common import id_and_text, lean, long_id, scratch, ship
from outletlens.llm.hashing import chunks
from outletlens.llm.tokens import encoder

GROUP_SEQUENCES = 8192
_CHUNK = 1 << 19


def sum_of_squares(lengths: np.ndarray, capacity: int):
    """Bin number and offset of each item (1 <= length <= capacity), in the given order."""
    count = np.zeros(capacity + 1, np.int64)         # open bins by residual gap
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    where = np.empty(len(lengths), np.int64)
    offset = np.empty(len(lengths), np.int64)
    n = 0
    never = np.int64(1) << 62
    for i, s in enumerate(lengths.tolist()):
        # change of the sum of squares if a bin of gap g becomes one of gap g - s
        change = 2 * (count[:capacity - s + 1] - count[s:]) + 2
        change[0] = 1 - 2 * count[s]                  # the bin is full: it leaves the sum
        change[count[s:] == 0] = never
        j = int(change.argmin())
        fresh = 2 * count[capacity - s] + 1 if s < capacity else 0
        if change[j] < fresh:
            gap = j + s
            b = bins[gap].pop()
            count[gap] -= 1
        else:
            gap, b = capacity, n
            n += 1
        where[i], offset[i] = b, capacity - gap
        if gap > s:
            bins[gap - s].append(b)
            count[gap - s] += 1
    return where, offset


def pieces(docs: DataFrame, spec: str, capacity: int, end_id: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's token pieces."""
    end = np.array([end_id], "<u4").tobytes()

    def go(batches):
        enc = encoder(spec)
        for pdf in batches:
            ids, texts = pdf["doc_id"].tolist(), [t or "" for t in pdf["text"].tolist()]
            for lo, hi in chunks([len(t) for t in texts], _CHUNK):
                out = []
                for doc, raw in zip(ids[lo:hi], enc.encode(texts[lo:hi]), strict=True):
                    raw += end
                    for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                        part = raw[at:at + 4 * capacity]
                        out.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
                yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
    return id_and_text(docs).mapInPandas(lean(go), "doc_id string, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    ship(docs.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as f:     # a fixed public file, read by the driver alone
        spec = f.read()
    cut = scratch(pieces(docs, spec, capacity, end_id), "pack-pieces")
    total = cut.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    groups = max(1, int(total) // (capacity * GROUP_SEQUENCES))

    def go(pdf):
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True])
        where, offset = sum_of_squares(pdf["length"].to_numpy(), capacity)
        return pdf.assign(sequence_id=pdf["lot"] * (1 << 32) + where, offset=offset).drop(columns="lot")
    # the written rows have fixed places, so their numbers survive a lost executor
    return long_id(cut.withColumn("lot", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
            .groupBy("lot").applyInPandas(go, "doc_id string, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"))
