"""Removal of byte strings that occur more than once (exact substring dedup).

Every byte covered by a ``width``-byte string that also starts anywhere else, in
the same text or another, is removed. Suffixes are compared by hashes: prefix
polynomial hashes and a binary search find the common extension of two suffixes,
so a comparison takes log(width) steps, a mergesort orders them, and neighbours
that agree over ``width`` bytes are verified byte by byte.

A suffix array of the corpus does not fit one machine, so the suffixes are dealt
out by content. Each ``width``-byte window has an anchor: its leftmost smallest
``GRAM``-byte hash. Equal windows have equal anchors at equal places, so only
suffixes with the same anchor and distance to it have to meet. Consecutive windows
with the same anchor occurrence form a run of about ``width / 2`` windows.

1. Runs whose anchor hash occurs once in the corpus are unique: they go.
2. Runs that agree in whole (hash of all their bytes) are counted with map-side
   combine: a count of two or more settles them, however many copies there are.
3. One run of each content still open ships its bytes to its anchor's bucket, where the
   suffixes are sorted as above. An anchor with more than ``GROUP`` different runs (a line or
   passage all over the corpus) ships none: 64-bit hashes of its windows are counted, and
   only windows whose hash counts twice are looked at again, by 128 bits.

Defined cases: null text is empty; texts below ``width`` bytes lose nothing; rows
are judged by text alone, so repeated rows (also with a repeated or null doc_id)
are copies of one another. Input columns other than doc_id and text pass through
``strip_repeats`` untouched.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from outletlens.llm.common import give_back, id_and_text, lean, long_id, scratch, ship, small
from outletlens.llm.hashing import chunks, mix, powers, prefix_hash, prefix_values, span_hash

GRAM = 64
#: Bytes of text that a task hashes at once (some 100 bytes of memory each).
_CHUNK = 1 << 19
#: Bits of a position within one buffer; longer texts are cut into overlapping buffers.
_POS = np.uint64(28)
_LONGEST = 4 << 20
#: Different runs of one anchor that are compared in one bucket; beyond, hashes of blocks of their windows are counted.
GROUP = 512
#: Windows in such a block, round by round; each is a multiple of the next.
SIDES = (64, 8, 1)
#: Suffixes that are sorted at once.
_SORTED = 100_000
#: Bytes that one bucket of shipped runs should hold (its suffixes take some 100 times as much memory).
BUCKET = 1 << 20


def _argmin(key: np.ndarray, w: int) -> np.ndarray:
    """For each window of w keys the smallest one, by block-wise running minima."""
    n = len(key)
    pad = np.full(-n % w, ~np.uint64(0), np.uint64)
    blocks = np.concatenate((key, pad)).reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()[w - 1:n]
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()[:n - w + 1]
    return np.minimum(left, right)


def _runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int):
    """Runs of windows with one anchor in the texts data[start:end]: text number,
    first and last window, anchor place (from the text's start), anchor hash, run hash."""
    gram, none = min(GRAM, width), np.empty(0, np.int64)
    w = width - gram + 1
    if len(data) < width:
        return (none,) * 6
    h = prefix_hash(data)
    grams = mix(h[gram:] - h[:-gram] * powers(gram)[gram])
    key = (grams >> _POS << _POS) | np.arange(len(grams), dtype=np.uint64)
    at = (_argmin(key, w) & ((np.uint64(1) << _POS) - np.uint64(1))).astype(np.int64)
    text = np.repeat(np.arange(len(starts)), np.maximum(ends - starts - width + 1, 0))
    if len(text) == 0:
        return (none,) * 6
    count = np.maximum(ends - starts - width + 1, 0)
    place = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(starts, count)
    at = at[place]
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (text[1:] != text[:-1]))))
    last = np.concatenate((new[1:], [len(text)])) - 1
    lo, hi, anchor, doc = place[new], place[last], at[new], text[new]
    whole = mix(span_hash(h, lo, hi - lo + width) + mix(((anchor - lo) << 32 | (hi - lo)).astype(np.uint64)))
    s = starts[doc]
    return doc, lo - s, hi - s, anchor - s, grams[anchor].view(np.int64), whole.view(np.int64)


def _text_runs(raw: list, width: int):
    """_runs of a list of byte strings, in buffers of bounded size."""
    for lo, hi in chunks([len(r) for r in raw], _CHUNK):
        if hi == lo + 1 and len(raw[lo]) > _LONGEST:
            step = _LONGEST - width + 1       # windows of the pieces follow one another
            for cut in range(0, len(raw[lo]) - width + 1, step):
                piece = np.frombuffer(raw[lo][cut:cut + _LONGEST], np.uint8)
                doc, a, b, p, g, s = _runs(piece, np.array([0]), np.array([len(piece)]), width)
                yield doc + lo, a + cut, b + cut, p + cut, g, s
            continue
        ends = np.cumsum([len(r) for r in raw[lo:hi]])
        starts = ends - np.array([len(r) for r in raw[lo:hi]])
        doc, *rest = _runs(np.frombuffer(b"".join(raw[lo:hi]), np.uint8), starts, ends, width)
        yield doc + lo, *rest


def _encoded(texts) -> list:
    return [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]


def text_runs(docs: DataFrame, width: int) -> DataFrame:
    """tkey (md5 of the text), lo, hi, at, anchor, run: the runs of every text."""
    def go(batches):
        for pdf in batches:
            texts = pdf["text"].tolist()
            for first, end in chunks([len(t or "") for t in texts], _CHUNK):
                raw = [r for r in _encoded(texts[first:end]) if len(r) >= width]
                keys = np.array([hashlib.md5(r, usedforsecurity=False).digest() for r in raw], object)
                for doc, lo, hi, at, anchor, run in _text_runs(raw, width):
                    yield pd.DataFrame({"tkey": keys[doc], "lo": lo, "hi": hi, "at": at, "anchor": anchor, "run": run})
    return docs.select(F.col("text").cast("string").alias("text")).mapInPandas(
        lean(go), "tkey binary, lo long, hi long, at long, anchor long, run long")


def _common(h, p, x, y, width):
    """Length of the common extension (at most width) of the suffixes at x and y, by binary search."""
    full = (h[x + width] - h[x] * p[width]) == (h[y + width] - h[y] * p[width])
    out = np.full(len(x), width)
    rest = np.flatnonzero(~full)
    x, y = x[rest], y[rest]
    hx, hy = h[x], h[y]
    lo, hi = np.zeros(len(x), np.int64), np.full(len(x), width - 1)   # common >= lo, <= hi
    while len(x) and (hi > lo).any():
        mid = (lo + hi + 1) >> 1
        same = (h[x + mid] - hx * p[mid]) == (h[y + mid] - hy * p[mid])
        lo = np.where(same, mid, lo)
        hi = np.where(same, hi, mid - 1)
    out[rest] = lo
    return out


def _less(data, h, p, x, y, width):
    """Whether the suffix at x sorts before the one at y, in their first width bytes."""
    c = _common(h, p, x, y, width)
    k = np.minimum(c, width - 1)
    return (c < width) & (data[x + k] < data[y + k])


def suffix_sort(data, h, place, group, width):
    """Order of the suffixes at ``place`` within each ``group`` (sorted, contiguous): a
    bottom-up mergesort of all groups at once. In each round every suffix finds its rank
    in the sibling run by binary search, each step a hash comparison of two suffixes."""
    p = powers(width)
    order = np.arange(len(place))
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    size = np.diff(np.concatenate((first, [len(group)])))
    step = 1
    while step < size.max(initial=0):
        work = np.flatnonzero(np.repeat(size, size) > step)    # positions in groups that still merge
        begin, count = np.repeat(first, size)[work], np.repeat(size, size)[work]
        inner = work - begin
        run = inner // step
        mine = run * step
        other = np.where(run % 2 == 0, mine + step, mine - step)
        lo = np.minimum(other, count)
        hi = np.minimum(other + step, count)
        base = lo.copy()
        right = run % 2 == 1          # equal suffixes: the left run's come first
        x = place[order[work]]
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) >> 1
            y = place[order[begin[open_] + mid]]
            r = right[open_]
            a, b = np.where(r, x[open_], y), np.where(r, y, x[open_])
            less = _less(data, h, p, a, b, width)
            go = np.where(r, ~less, less)   # the sibling's element stays before mine
            lo[open_] = np.where(go, mid + 1, lo[open_])
            hi[open_] = np.where(go, hi[open_], mid)
        to = begin + np.minimum(mine, np.where(right, other, mine)) + (inner - mine) + (lo - base)
        nxt = order.copy()
        nxt[to] = order[work]
        order = nxt
        step *= 2
    return order


def _row_hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Prefix hashes that begin anew at each start (each row of data ends with a byte of its
    own that no suffix reaches), so that powers only go up to the longest row."""
    size = np.diff(np.append(starts, len(data)))
    at = np.arange(len(data)) - np.repeat(starts, size)
    value = prefix_values(data, at)
    total = np.cumsum(value) - value                  # before each byte
    h = (total - np.repeat(total[starts], size)) * powers(int(size.max()))[np.maximum(at - 1, 0)]
    h[starts] = 0
    return h


def _repeated(data, h, place, group, width):
    """Which suffixes agree over width bytes with another one of their group (sorted, contiguous)."""
    hit = np.zeros(len(place), bool)
    edge = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(group) else np.zeros(0, np.int64)
    for lo, hi in chunks(np.diff(np.append(edge, len(group))).tolist(), _SORTED):
        a, b = edge[lo], edge[hi] if hi < len(edge) else len(group)
        hit[a:b] = _repeated_part(data, h, place[a:b], group[a:b], width)
    return hit


def _repeated_part(data, h, place, group, width):
    hit = np.zeros(len(place), bool)
    if len(place) < 2:
        return hit
    order = suffix_sort(data, h, place, group, width)
    x, y = order[:-1], order[1:]
    near = np.flatnonzero(group[x] == group[y])
    x, y = x[near], y[near]
    near = np.flatnonzero(_common(h, powers(width), place[x], place[y], width) >= width)
    x, y = x[near], y[near]
    for lo in range(0, len(x), 1 << 14):      # collision verification
        span = np.arange(width)
        a, b = x[lo:lo + (1 << 14)], y[lo:lo + (1 << 14)]
        same = (data[place[a][:, None] + span] == data[place[b][:, None] + span]).all(axis=1)
        hit[a[same]] = True
        hit[b[same]] = True
    return hit


def _compare_bucket(pdf: pd.DataFrame, width: int) -> pd.DataFrame:
    """tkey, lo, hi of the maximal stretches of repeated windows among the shipped runs of a bucket."""
    pdf = pdf.reset_index(drop=True)
    n = pdf["windows"].to_numpy()
    data = np.frombuffer(b"\0".join(pdf["raw"]) + b"\0", np.uint8)
    size = np.array([len(r) + 1 for r in pdf["raw"]])
    h = _row_hashes(data, np.cumsum(size) - size)
    row = np.repeat(np.arange(len(pdf)), n)
    step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    place = np.repeat(np.cumsum(size) - size, n) + step
    anchor = np.unique(pdf["anchor"].to_numpy(), return_inverse=True)[1]
    distance = pdf["distance"].to_numpy()[row] - step       # of the window's start to the anchor
    group = anchor[row] * np.int64(width) + distance
    order = np.argsort(group, kind="stable")
    size = np.unique(group, return_counts=True)[1]
    order = order[np.repeat(size, size) > 1]
    hit = np.zeros(len(row), bool)
    hit[order] = _repeated(data, h, place[order], group[order], width)
    new = np.concatenate(([True], (row[1:] != row[:-1]) | (hit[1:] != hit[:-1])))
    begin = np.flatnonzero(new)
    end = np.concatenate((begin[1:], [len(row)])) - 1
    keep = hit[begin]
    begin, end = begin[keep], end[keep]
    lo = pdf["lo"].to_numpy()[row[begin]]
    return pd.DataFrame({"anchor": pdf["anchor"].to_numpy()[row[begin]], "run": pdf["run"].to_numpy()[row[begin]],
                         "from": lo - pdf["first"].to_numpy()[row[begin]] + step[begin],
                         "to": lo - pdf["first"].to_numpy()[row[begin]] + step[end]})


def _texts_with(docs: DataFrame, runs: DataFrame, width: int) -> DataFrame:
    """Each distinct text that has some of these runs, with them."""
    wanted = scratch(runs.groupBy("tkey").agg(F.collect_list(F.struct("anchor", "run", F.col("n").alias("copies"), "lo", "hi", "at")).alias("wanted")), "substr-wanted")
    texts = (docs.select(F.col("text").cast("string").alias("text")).where(F.octet_length("text") >= width)
             .withColumn("tkey", F.unhex(F.md5(F.encode("text", "utf-8"))))
             .join(small(wanted.select("tkey")), "tkey", "left_semi").dropDuplicates(["tkey"]))
    return texts.join(wanted, "tkey")


def _few_kinds(docs: DataFrame, runs: DataFrame, width: int) -> DataFrame:
    """(anchor, run, from, to): repeated windows of anchors with few kinds of runs, which are sorted side by side."""
    def cut(batches):
        names = ["anchor", "run", "windows", "distance", "lo", "first", "raw"]
        for pdf in batches:
            out = []
            for raw, some in zip(_encoded(pdf["text"]), pdf["wanted"], strict=True):
                out += [(k["anchor"], k["run"], k["hi"] - k["lo"] + 1, k["at"] - k["lo"], k["lo"], k["lo"], raw[k["lo"]:k["hi"] + width]) for k in some]
                if len(out) > 5000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            if out:
                yield pd.DataFrame(out, columns=names)

    def compare(pdf):
        out = _compare_bucket(pdf, width)
        give_back()
        return out
    total = runs.agg(F.coalesce(F.sum(F.col("hi") - F.col("lo") + width), F.lit(0))).first()[0]
    buckets = max(1, int(total) // BUCKET)
    shipped = _texts_with(docs, runs, width).mapInPandas(
        lean(cut), "anchor long, run long, windows long, distance long, lo long, first long, raw binary")
    return (shipped.withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets))).groupBy("bucket")
            .applyInPandas(compare, "anchor long, run long, from long, to long"))


def _blocks(pdf: pd.DataFrame, side: int, before: int, width: int) -> pd.DataFrame:
    """Blocks of ``side`` neighbouring windows of some runs (of all their windows, or of the blocks of ``before``
    windows that are listed), by the windows' distances to the anchor: hash of the bytes that all windows of the
    block share, and of all its bytes where the run has the whole block."""
    size = np.array([len(r) for r in pdf["raw"]])
    data = np.frombuffer(b"".join(pdf["raw"]), np.uint8)
    low, high, run = (pdf[c].to_numpy() for c in ("low", "high", "run"))
    row = np.arange(len(pdf))
    first, last = low, high
    if before:
        inside = [np.asarray(x, np.int64) for x in pdf["blocks"]]
        row = np.repeat(row, [len(x) for x in inside])
        first = np.concatenate(inside) * before
        first, last = np.maximum(first, low[row]), np.minimum(first + before - 1, high[row])
    n = last // side - first // side + 1
    block = np.repeat(first // side, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    row = np.repeat(row, n)
    near, far = block * side, block * side + side - 1
    at = (np.cumsum(size) - size + high)[row]                # a run's bytes begin at its window farthest from the anchor
    full = (near >= low[row]) & (far <= high[row])
    whole, other = run[row].copy(), np.zeros(len(row), np.int64)
    h = prefix_hash(data)
    core = span_hash(h, at - near, width - side + 1).view(np.int64)
    whole[full] = span_hash(h, (at - far)[full], width + side - 1).view(np.int64)
    # the complement's bytes have values of their own: a second, independent hash
    other[full] = span_hash(prefix_hash(255 - data), (at - far)[full], width + side - 1).view(np.int64)
    return pd.DataFrame({"anchor": pdf["anchor"].to_numpy()[row], "run": run[row], "copies": pdf["copies"].to_numpy()[row], "block": block,
                         "core": core, "full": full, "whole": whole, "other": other, "from": high[row] - far})


def _many_kinds(docs: DataFrame, runs: DataFrame, width: int) -> DataFrame:
    """The same for anchors in many different contexts (a line or passage all over the corpus). No task
    takes such an anchor's runs, and their windows are not listed one by one: they are compared in blocks of
    neighbours, of ``SIDES`` windows each. Where the bytes that a block's windows share occur in one run only,
    none of them is repeated; blocks that agree in whole (by 128 bits) are repeated in all their runs; one run of
    each content of the others, and of those they may share windows with, is looked at in smaller blocks."""
    none = "anchor long, run long, from long, to long"
    if runs.isEmpty():
        return runs.sparkSession.createDataFrame([], none)

    def cut(batches):
        for pdf in batches:
            for raw, some in zip(_encoded(pdf["text"]), pdf["wanted"], strict=True):
                for lo, hi in chunks([k["hi"] - k["lo"] + width for k in some], _CHUNK):
                    yield pd.DataFrame([(k["anchor"], k["run"], k["copies"], k["at"] - k["hi"], k["at"] - k["lo"], raw[k["lo"]:k["hi"] + width])
                                        for k in some[lo:hi]], columns=["anchor", "run", "copies", "low", "high", "raw"])

    def blocks(side, before):
        def go(batches):
            for pdf in batches:
                for lo, hi in chunks([len(r) for r in pdf["raw"]], _CHUNK):
                    yield _blocks(pdf.iloc[lo:hi], side, before, width)
        return lean(go)

    raw = scratch(_texts_with(docs, runs, width).mapInPandas(
        lean(cut), "anchor long, run long, copies long, low long, high long, raw binary"), "substr-raw")
    found, before, left = [], 0, raw
    for side in [x for x in SIDES if 2 * x <= width or x == 1]:
        seen = scratch(left.mapInPandas(blocks(side, before), "anchor long, run long, copies long, block long, core long, full boolean, "
                                        "whole long, other long, from long"), "substr-seen")
        kind = ["anchor", "block", "core", "full", "whole", "other"]
        kinds = scratch(seen.groupBy(*kind).agg(F.count("*").alias("n"), F.min("run").alias("run")), "substr-blocks")
        same = scratch(kinds.where("n > 1").select(*kind), "substr-same")
        # runs with copies of their own are repeated in whole anyway
        found.append(seen.where("copies = 1").join(small(same), kind, "left_semi")
                     .select("anchor", "run", "from", (F.col("from") + side - 1).alias("to")))
        if side == 1:
            break
        mixed = scratch(kinds.groupBy("anchor", "block", "core").agg(F.sum("n").alias("of"), F.min("n").alias("least"))
                        .where((F.col("of") > 1) & (F.col("least") == 1)).select("anchor", "block", "core"), "substr-cores")
        inside = kinds.join(small(mixed), ["anchor", "block", "core"], "left_semi").groupBy("anchor", "run").agg(F.collect_list("block").alias("blocks"))
        left, before = raw.join(inside, ["anchor", "run"]), side
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    # neighbours become one stretch; a run has fewer windows than width
    order = Window.partitionBy("anchor", "run").orderBy("from", "to")
    reached = F.max("to").over(order.rowsBetween(Window.unboundedPreceding, -1))
    hits = hits.withColumn("fresh", F.when(F.col("from") <= reached + 1, 0).otherwise(1)).withColumn("island", F.sum("fresh").over(order))
    return hits.groupBy("anchor", "run", "island").agg(F.min("from").alias("from"), F.max("to").alias("to")).drop("island")


def repeated_spans(docs: DataFrame, width: int = 400) -> DataFrame:
    """tkey, spans (array of [from, to) byte ranges, not yet merged) of every distinct text that loses bytes."""
    ship(docs.sparkSession)
    runs = scratch(text_runs(docs, width), "substr-runs")
    # written first: a join of two plain shuffles is one whose hot keys can be split
    anchors = scratch(runs.groupBy("anchor").count().where("count > 1").select("anchor"), "substr-anchors")
    runs = scratch(runs.join(anchors, "anchor"), "substr-shared")
    kinds = runs.groupBy("anchor", "run").agg(F.count("*").alias("n"), F.min(F.struct("tkey", "lo", "hi", "at")).alias("of"))
    kinds = scratch(kinds, "substr-kinds")
    anchors = scratch(kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("n").alias("least"))
                      .where("kinds > 1 and least = 1").drop("least"), "substr-mixed")
    open_ = scratch(kinds.join(anchors, "anchor").select("anchor", "run", "kinds", "n", "of.*"), "substr-open")

    found = _few_kinds(docs, open_.where(F.col("kinds") <= GROUP), width).unionByName(_many_kinds(docs, open_.where(F.col("kinds") > GROUP), width))
    whole = kinds.where("n > 1").select("anchor", "run", F.lit(0).cast("long").alias("from"), (F.col("of.hi") - F.col("of.lo")).alias("to"))
    spans = scratch(found.unionByName(whole), "substr-found")
    # kinds are few columns; each of their runs, in every text, loses the same relative bytes
    hits = runs.join(spans, ["anchor", "run"]).select("tkey", (F.col("lo") + F.col("from")).alias("from"), (F.col("lo") + F.col("to") + width).alias("to"))
    return hits.groupBy("tkey").agg(F.collect_set(F.struct("from", "to")).alias("spans"))


def merged(spans) -> list:
    """Maximal [from, to) ranges of possibly overlapping or touching ranges."""
    out: list = []
    for lo, hi in sorted((s["from"], s["to"]) for s in spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


def with_spans(docs: DataFrame, width: int = 400) -> DataFrame:
    """The rows of ``docs`` with an extra column llm_spans (null: nothing repeats)."""
    spans = scratch(repeated_spans(docs, width), "substr-spans").withColumnRenamed("tkey", "llm_tkey").withColumnRenamed("spans", "llm_spans")
    key = F.unhex(F.md5(F.encode(F.col("text").cast("string"), "utf-8")))
    return docs.withColumn("llm_tkey", key).join(spans, "llm_tkey", "left").drop("llm_tkey")


def removal_digest(docs: DataFrame, width: int = 400) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of the remaining bytes)."""
    def go(batches):
        for pdf in batches:
            out = []
            for raw, spans in zip(_encoded(pdf["text"]), pdf["llm_spans"], strict=True):
                cuts = merged(spans) if spans is not None else []
                at, kept = 0, hashlib.sha256()
                for lo, hi in cuts:
                    kept.update(raw[at:lo])
                    at = hi
                kept.update(raw[at:])
                out.append((len(raw), sum(hi - lo for lo, hi in cuts), len(cuts), kept.hexdigest()))
            yield pd.concat([pdf["doc_id"].reset_index(drop=True), pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])], axis=1)
    return long_id(with_spans(id_and_text(docs), width).select("doc_id", "text", "llm_spans").mapInPandas(
        lean(go), "doc_id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))


def strip_repeats(docs: DataFrame, width: int = 400) -> DataFrame:
    """``docs`` with repeated bytes taken out of ``text``. Characters that a cut
    would split go whole; a null text stays null."""
    @F.pandas_udf("string")
    def strip(text: pd.Series, spans: pd.Series) -> pd.Series:
        def one(t, s):
            if t is None or s is None:
                return t
            raw, at, kept = t.encode("utf-8", "surrogatepass"), 0, []
            for lo, hi in merged(s):
                kept.append(raw[at:lo].decode("utf-8", "ignore"))
                at = hi
            kept.append(raw[at:].decode("utf-8", "ignore"))
            return "".join(kept)
        return pd.Series([one(t, s) for t, s in zip(text, spans, strict=True)], dtype=object)
    return with_spans(docs, width).withColumn("text", strip(F.col("text").cast("string"), "llm_spans")).drop("llm_spans")


#: The digest by grouping every 400-byte string of the corpus.
SQL = """
WITH raw AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, row_number() OVER () AS k FROM documents),
strings AS (
    SELECT k, i, md5(substr(h, (2 * i + 1)::BIGINT, 800)) AS s
    FROM (SELECT k, h, unnest(range(length(h) // 2 - 399)) AS i FROM raw)),
twice AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY s) AS n FROM strings) WHERE n > 1),
steps AS (SELECT k, i, CASE WHEN i > lag(i) OVER (PARTITION BY k ORDER BY i) + 400 THEN 1 ELSE 0 END AS fresh FROM twice),
runs AS (
    SELECT k, min(i) AS lo, max(i) + 400 AS hi
    FROM (SELECT k, i, sum(fresh) OVER (PARTITION BY k ORDER BY i) AS run FROM steps) GROUP BY k, run),
cut AS (SELECT k, sum(hi - lo) AS removed, count(*) AS spans, list(lo ORDER BY lo) AS los, list(hi ORDER BY lo) AS his FROM runs GROUP BY k)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
    sha256(unhex(CASE WHEN spans IS NULL THEN h ELSE array_to_string(list_transform(range(1, spans + 2), lambda j:
        substr(h, (2 * coalesce(his[j - 1], 0) + 1)::BIGINT, (2 * (coalesce(los[j], length(h) // 2) - coalesce(his[j - 1], 0)))::BIGINT)), '') END)) AS kept_sha256
FROM raw LEFT JOIN cut USING (k)
"""
