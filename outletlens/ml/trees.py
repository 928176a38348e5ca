"""Regression trees, forests and boosting on binned rows (M6-M8, M13), many fits side by side.

The learners are MLlib's (variance gain, at most 32 bins a feature with split points between neighbouring values,
boosting on twice the residual with a first tree of weight 1); what differs is how rows are held and summed:

* Rows are binned once into blocks of at most a few ten thousand rows, a small number a feature. Candidate split points come
  from all rows up to ``SPLIT_ROWS``, above from a seeded sample of about as many, as in MLlib. Every row is fitted on.
  Blocks are dealt over all cores whatever files the rows came in, each partition's blocks being of one fit: a level
  gives one table of sums a partition and node, so their number does not grow with the rows or the fits.
* One set of blocks holds several fits (the whole training set and each fold's), and a level of all of them is
  one job: a task sums its blocks by (fit, tree, node, feature, bin), what is shuffled is one such table a task,
  and one best split per node reaches the driver.
* A boosting round is ``max_depth`` such jobs. The rows' predictions are kept beside the blocks (8 bytes a row and fit, the
  rows are not written again); a reliable checkpoint every ``checkpoint_every`` rounds cuts their lineage and takes the
  place of the one before.
* A forest's nodes are split like that only while more than ``subtree_rows`` rows fall in them. Rows of a smaller node
  are sent to one task, which grows the rest: a row is shuffled once a tree it was drawn for, not summed anew
  at each level. Trees go in waves of about ``WAVE_BYTES``, and a wave's shuffle files are removed before the next: what lies on
  disk does not grow with the trees. A set that is no larger than that goes once to each of a few tasks, which draw and grow their share of
  the trees from it. How often a row is drawn (bootstrap) is a hash of its content and the tree, so it does not
  depend on partitions.
* Forests deeper than ``DRIVER_DEPTH`` have about as many nodes as rows: their subtrees stay on the
  executors, and rows to be scored are sent to them.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel, TaskContext
from pyspark.rdd import portable_hash
from pyspark.serializers import BatchedSerializer, CPickleSerializer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import FEATURES
from ..session import checkpoint_dir, delete_checkpoint, delete_shuffle, materialize, ship

SEED = 42
MAX_BINS = 32
SPLIT_ROWS = 20_000
BLOCK_ROWS = 1 << 15
PIECE_ROWS = 1 << 10         # smaller sets are not cut further
SUBTREE_ROWS = 200_000
DRIVER_DEPTH = 12
FEW_ROWS = 16               # nodes of so few rows are split by sorting them
WAVE_BYTES = 1 << 31       # rows sent to the subtrees at a time
DRIVER_BYTES = 8 << 20     # tables of a level up to this are added on the driver
LEARNERS = ("Random Forest", "Gradient Boosting", "Boosted Trees (deep)")
_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 16)]))


# --- one tree: arrays (feature, bin or split point, left child, value); the right child is the next one ---------
class Tree:
    """A tree being grown; node 0 is the root. A leaf points at itself, and nothing lies beyond its split."""

    def __init__(self):
        self.feat, self.bin, self.left, self.value = [0], [65535], [0], [0.0]

    def split(self, node: int, feature: int, last: int, left_value: float, right_value: float) -> int:
        at = len(self.feat)
        self.feat[node], self.bin[node], self.left[node] = feature, last, at
        for i, v in ((at, left_value), (at + 1, right_value)):
            self.feat.append(0)
            self.bin.append(65535)
            self.left.append(i)
            self.value.append(v)
        return at

    def arrays(self):
        return (np.array(self.feat, np.int16), np.array(self.bin, np.uint16), np.array(self.left, np.int64), np.array(self.value))


def _walk(feat, cut, left, x, depth: int, start=None) -> np.ndarray:
    """Every column's node of ``x`` (features x rows) after ``depth`` steps; ``x <= cut`` goes left."""
    rows = np.arange(x.shape[1])
    at = np.zeros(x.shape[1], np.int64) if start is None else start
    for _ in range(depth):
        at = left[at] + (x[feat[at], rows] > cut[at])
    return at


def _sums(bins, at, nodes: int, weight, target, n_bins: int) -> np.ndarray:
    """(node, feature, bin, [weight, weight * target]) sums of a block's rows."""
    out = np.empty((nodes, len(bins), n_bins, 2))
    base, size = at * n_bins, nodes * n_bins
    product = target if weight is None else target * weight
    for f, b in enumerate(bins):
        i = base + b
        out[:, f, :, 0] = np.bincount(i, weight, size).reshape(nodes, n_bins)
        out[:, f, :, 1] = np.bincount(i, product, size).reshape(nodes, n_bins)
    return out


def best_splits(sums: np.ndarray):
    """Per node (weight, sum, feature, last bin of the left side, left weight, left sum); feature -1 where no split gains.
    Ties go to the first feature, then to the lowest split point."""
    run = np.cumsum(sums, axis=2)
    w, s = run[:, :, -1, 0], run[:, :, -1, 1]
    wl, sl = run[:, :, :-1, 0], run[:, :, :-1, 1]
    wr, sr = w[:, :, None] - wl, s[:, :, None] - sl
    ok = (wl >= 1) & (wr >= 1)
    base = (s * s / w)[:, :, None]
    gain = np.where(ok, sl * sl / np.where(ok, wl, 1) + sr * sr / np.where(ok, wr, 1) - base, -np.inf)
    gain = np.where(gain > 1e-12 * np.abs(base), gain, -np.inf)
    flat = gain.reshape(len(gain), -1)
    best, i = flat.argmax(axis=1), np.arange(len(flat))
    f, b = np.divmod(best, gain.shape[2])
    f_or_none = np.where(flat[i, best] == -np.inf, -1, f)
    return w[:, 0], s[:, 0], f_or_none, b, wl[i, f, b], sl[i, f, b]


def best_splits_of_few(bins: np.ndarray, rows: np.ndarray, weight: np.ndarray, target: np.ndarray):
    """``best_splits`` of nodes of few rows, without a table of sums: ``rows`` has a line of row numbers a node, -1 where
    it has fewer. Each feature's rows are sorted by their bins; a split can lie where the bin changes."""
    k, m = rows.shape
    n_features, bits = len(bins), int(m - 1).bit_length()
    there, r = rows >= 0, np.maximum(rows, 0)
    # a row's bin and place in one number; what fills up a line comes last, with no weight
    key = np.where(there, bins[:, r], np.uint8(MAX_BINS)).transpose(1, 0, 2).astype(np.int16)
    key = np.sort((key << bits) | np.arange(m, dtype=np.int16), axis=2)
    key = np.ascontiguousarray(key.reshape(k * n_features, m).T)
    b, i = key >> bits, (key & ((1 << bits) - 1)) + np.repeat(np.arange(k) * m, n_features)
    w = np.where(there, weight[r], 0.0)
    wy = np.where(there, w * target[r], 0.0).ravel()
    w = w.ravel()
    run_w, run_s = w[i], wy[i]      # by places, (node, feature) side by side
    of_bin, before = run_s[0], np.zeros(k * n_features)
    for j in range(1, m):           # a bin's rows are added up before they are added to the bins below, as in ``_sums``
        same = b[j] == b[j - 1]
        before = np.where(same, before, run_s[j - 1])
        of_bin = np.where(same, of_bin + run_s[j], run_s[j])
        np.add(before, of_bin, out=run_s[j])
        run_w[j] += run_w[j - 1]
    # the last row's sums: the fillers after it add nothing
    all_w, all_s = run_w[-1], run_s[-1]
    base = all_s * all_s / all_w
    least = 1e-12 * np.abs(base)
    best, at = np.full(k * n_features, -np.inf), np.zeros(k * n_features, np.int64)
    for j in range(m - 1):
        ok = (b[j + 1] != b[j]) & (b[j + 1] < MAX_BINS)
        wl, sl = run_w[j], run_s[j]
        sr = all_s - sl
        gain = sl * sl / wl + sr * sr / np.where(ok, all_w - wl, 1.0) - base
        better = ok & (gain > least) & (gain > best)
        best = np.where(better, gain, best)
        at[better] = j
    # the first feature, then the lowest split point
    best = best.reshape(k, n_features)
    f = best.argmax(axis=1)
    here = np.arange(k) * n_features + f
    p = at[here]
    return (all_w[::n_features], all_s[::n_features], np.where(best[np.arange(k), f] == -np.inf, -1, f), b[p, here].astype(np.int64),
            run_w[p, here], run_s[p, here])


def _draws(key: np.ndarray, tree: int) -> np.ndarray:
    """How often each row is drawn for a tree: Poisson(1) of a hash of the row's key."""
    z = key ^ np.uint64((SEED * 0x9E3779B97F4A7C15 + (tree + 1) * 0xD1342543DE82EF95) % 2 ** 64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    z ^= z >> np.uint64(31)
    return np.searchsorted(_POISSON, (z >> np.uint64(11)) / 2.0 ** 53, side="right").astype(np.uint8)


# --- rows in blocks ------------------------------------------------------------------------------------------------
def split_points(rows: np.ndarray) -> list:
    """MLlib's candidate split points of each column: between all neighbouring values if they are few, else
    between the values next to equal shares of the rows."""
    out = []
    most = min(MAX_BINS, max(len(rows), 1)) - 1
    for x in rows.T:
        values, counts = np.unique(x, return_counts=True)
        if len(values) - 1 <= most:
            out.append((values[:-1] + values[1:]) / 2.0)
            continue
        points, stride = [], len(x) / (most + 1)
        upto, goal = counts[0], stride
        for i in range(1, len(values)):
            before, upto = upto, upto + counts[i]
            if abs(before - goal) < abs(upto - goal):
                points.append((values[i - 1] + values[i]) / 2.0)
                goal += stride
        out.append(np.array(points))
    return out


@dataclass
class Blocks:
    """Rows in blocks ``(fit, bins, label, F, key)``; ``bins`` has one line a feature."""
    rdd: object
    fits: list                      # what each fit leaves out: a fold, or None
    points: list                    # per fit and feature the split points
    counts: list                    # rows per fit
    features: list
    lanes: int = 1                  # partitions a fit

    def unpersist(self):
        self.rdd.unpersist()


def _singly(rdd):
    """``rdd`` serialised element by element, so that two such RDDs can be zipped as they are."""
    return rdd._reserialize(BatchedSerializer(CPickleSerializer(), 1))


class Predictions:
    """The rows' predictions while a booster grows, beside the blocks they belong to."""

    def __init__(self, blocks: Blocks):
        self.blocks, self.held, self.before, self.written = blocks, None, None, None

    def rdd(self):
        """The blocks with the newest predictions."""
        if self.held is None:
            return self.blocks.rdd
        return self.blocks.rdd.zip(self.held).map(lambda x: (*x[0][:3], x[1], x[0][4]))

    def settled(self) -> None:
        """A job has read the newest predictions: those before go, and the checkpoint before if a newer one is there."""
        if self.before is not None:
            self.before.unpersist()
            self.before = None
        if self.held is not None and self.held.getCheckpointFile() not in (None, self.written):
            if self.written is not None:
                delete_checkpoint(self.held, self.written)
            self.written = self.held.getCheckpointFile()

    def add(self, grown: dict, rate: float, depth: int, checkpoint: bool) -> None:
        """Add each row's leaf value, times ``rate``."""
        def added(block):
            fit, bins, _, pred, _ = block
            feat, cut, left, value = grown[fit]
            return pred + value[_walk(feat, cut, left, bins, depth)] * rate
        new = _singly(self.rdd().map(added)).persist(StorageLevel.MEMORY_AND_DISK)
        self.before, self.held = self.held, new
        if checkpoint:
            new.checkpoint()

    def drop(self) -> None:
        self.settled()
        if self.held is not None:
            self.held.unpersist()
        if self.written is not None:
            delete_checkpoint(self.held, self.written)


def _bin(x: np.ndarray, points, side: str = "left") -> np.ndarray:
    """(features x rows) bin numbers: how many split points lie below a value (``right``: or at it)."""
    size = np.uint8 if all(len(p) < 256 for p in points) else np.uint16
    return np.stack([np.searchsorted(p, v, side=side).astype(size) for p, v in zip(points, x)])


def _matrix(pdf: pd.DataFrame, n: int) -> np.ndarray:
    x = pdf.iloc[:, :n].to_numpy(dtype=float).T
    if np.isnan(x).any():
        raise ValueError("NULL or NaN among the features")
    return np.ascontiguousarray(x)


def binned(train: DataFrame, features=FEATURES, fits=(None,), fold: str = "fold", start=None) -> Blocks:
    """``train`` (flat feature columns, ``label``, and ``fold`` if a fit leaves one out) as persisted blocks.
    ``start``: each fit's first prediction (0)."""
    features, fits = list(features), list(fits)
    n_features = len(features)
    by_fold = any(f is not None for f in fits)
    rows = flat_rows(train, [F.col(f).cast("double") for f in features], features, fold if by_fold else None)
    per_fold = {r["fold"]: r["n"] for r in rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}   # folds rows
    counts = [sum(n for k, n in per_fold.items() if f is None or k != f) for f in fits]
    total = sum(per_fold.values())
    if not all(counts):
        raise ValueError("no rows to fit on")
    # the split points' rows only, as MLlib samples them: about SPLIT_ROWS x features numbers
    seen = (rows if total <= SPLIT_ROWS else rows.sample(SPLIT_ROWS / total, seed=SEED)).drop("key", "y").toPandas()
    x, of = seen.iloc[:, :n_features].to_numpy(float), seen["fold"].to_numpy()
    points = [split_points(x if f is None else x[of != f]) for f in fits]
    return in_blocks(rows, features, fits, points, counts, start or [0.0] * len(fits))


def flat_rows(train: DataFrame, values, features, fold: str | None) -> DataFrame:
    """(x0, x1, ..., y, key, fold)"""
    return train.select(*[v.alias(f"x{i}") for i, v in enumerate(values)], F.col("label").cast("double").alias("y"),
                        F.xxhash64(*features, "label").alias("key"), (F.col(fold) if fold else F.lit(-1)).cast("int").alias("fold"))


def in_blocks(rows: DataFrame, features: list, fits: list, points: list, counts: list, start: list, side: str = "left") -> Blocks:
    """``flat_rows`` as persisted blocks of each fit's own bins, dealt over the cores."""
    spark, n_features = rows.sparkSession, len(features)
    lanes = max(1, -(-spark.sparkContext.defaultParallelism // len(fits)))
    pieces = [min(BLOCK_ROWS, max(PIECE_ROWS, -(-n // lanes))) for n in counts]

    def block(pdf):
        x, y = _matrix(pdf, n_features), pdf["y"].to_numpy(float)
        key, of = pdf["key"].to_numpy(np.int64).view(np.uint64), pdf["fold"].to_numpy()
        # equal rows are drawn apart from one another
        order = np.argsort(key, kind="stable")
        first = np.r_[True, key[order][1:] != key[order][:-1]]
        start = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
        nth = np.empty(len(key), np.uint64)
        nth[order] = (np.arange(len(key)) - start).astype(np.uint64)
        key = key + nth * np.uint64(0x9E3779B97F4A7C15)
        for k, f in enumerate(fits):
            keep = np.arange(len(y)) if f is None else np.flatnonzero(of != f)
            for at in range(0, len(keep), pieces[k]):
                use = keep[at:at + pieces[k]]
                yield k, pickle.dumps((_bin(x[:, use], points[k], side), y[use], key[use]), protocol=5)

    def blocks(it):
        held, size, part, dealt = [], 0, TaskContext.get().partitionId(), [0] * len(fits)

        def made():
            found = []
            for k, b in block(pd.concat(held, ignore_index=True)):
                found.append((k * lanes + (part + dealt[k]) % lanes, part, dealt[k], b))
                dealt[k] += 1
            return pd.DataFrame(found, columns=["lane", "part", "i", "block"])
        for pdf in it:
            held.append(pdf)
            size += len(pdf)
            if size >= BLOCK_ROWS:
                yield made()
                held, size = [], 0
        if size:
            yield made()

    def opened(r):
        (lane, _, _), b = r
        bins, y, key = pickle.loads(b)
        return lane // lanes, bins, y, np.full(len(y), start[lane // lanes]), key
    checkpoint_dir(spark)
    ship(spark)
    dealt = rows.mapInPandas(blocks, "lane int, part int, i int, block binary").rdd.map(lambda r: ((r.lane, r.part, r.i), r.block))
    rdd = dealt.repartitionAndSortWithinPartitions(lanes * len(fits), lambda k: k[0]).map(opened)
    return Blocks(_singly(rdd).persist(StorageLevel.MEMORY_AND_DISK), fits, points, counts, features, lanes)


def _level(rdd, n_features: int, trees: dict, depth: int, open_nodes: dict, target, bootstrap: bool,
           n_bins: int = MAX_BINS, score=best_splits, lanes: int | None = None) -> dict:
    """One level as one job: ``{(fit, tree): {node: best split}}`` of the open nodes."""
    grown = {k: trees[k].arrays() for k, nodes in open_nodes.items() if nodes}
    wanted = {k: sorted(nodes) for k, nodes in open_nodes.items() if nodes}

    def part(blocks):
        acc = {}
        for fit, bins, y, pred, key in blocks:
            g = target(fit, y, pred)
            for (k, t), nodes in wanted.items():
                if k != fit:
                    continue
                feat, cut, left, _ = grown[k, t]
                place = np.full(len(feat), -1, np.int64)
                place[nodes] = np.arange(len(nodes))
                at = place[_walk(feat, cut, left, bins, depth)]
                w = _draws(key, t) if bootstrap else None
                use = (at >= 0) if w is None else (at >= 0) & (w > 0)
                if use.all():
                    found = _sums(bins, at, len(nodes), w, g, n_bins)
                else:
                    found = _sums(bins[:, use], at[use], len(nodes), None if w is None else w[use], g[use], n_bins)
                acc[k, t] = found if (k, t) not in acc else acc[k, t] + found
        for (k, t), sums in acc.items():
            for i, node in enumerate(wanted[k, t]):
                yield (k, t, node), sums[i]

    def best(sums):
        return tuple(v[0].item() for v in score(sums[None]))
    nodes, sums = sum(map(len, wanted.values())), rdd.mapPartitions(part)
    if nodes * n_features * n_bins * 16 * (lanes or rdd.getNumPartitions()) <= DRIVER_BYTES:
        added = {}                  # few tables: a second stage would take longer than adding them here
        for key, v in sums.collect():
            added[key] = added[key] + v if key in added else v
        found = [(key, best(v)) for key, v in added.items()]
    else:
        found = sums.reduceByKey(lambda a, b: a + b, min(rdd.context.defaultParallelism, nodes)).mapValues(best).collect()
    out = {}
    for (k, t, node), r in found:
        out.setdefault((k, t), {})[node] = r
    return out


def _mean(w: float, s: float) -> float:
    return s / w


def _grow_level(trees: dict, found: dict, value=_mean) -> dict:
    """Split the trees' nodes; ``{(fit, tree): {child: weight}}`` of the new nodes."""
    children = {}
    for k, nodes in found.items():
        for node in sorted(nodes):
            w, s, f, b, wl, sl = nodes[node]
            if not w:
                continue
            trees[k].value[node] = value(w, s)
            if f >= 0:
                at = trees[k].split(node, f, b, value(wl, sl), value(w - wl, s - sl))
                children.setdefault(k, {}).update({at: wl, at + 1: w - wl})
    return children


def grow_trees(rdd, n_features: int, fits, depth: int, target, value=_mean, **how) -> dict:
    """One tree per fit to ``depth``, a job a level."""
    trees = {(k, 0): Tree() for k in fits}
    open_nodes = {k: [0] for k in trees}
    for level in range(depth):
        children = _grow_level(trees, _level(rdd, n_features, trees, level, open_nodes, target, False, **how), value)
        open_nodes = {k: [c for c, w in nodes.items() if w > 1] for k, nodes in children.items()}
        if not any(open_nodes.values()):
            break
    return {k: t for (k, _), t in trees.items()}


# --- models ---------------------------------------------------------------------------------------------------------
@dataclass
class TreeModel:
    """A sum of trees: the first at weight ``first``, the others at ``rate``; or their mean (``rate`` None)."""
    name: str
    trees: list                      # arrays (feature, split point, left child, value)
    rate: float | None
    depth: int
    features: list = field(default_factory=lambda: list(FEATURES))
    first: float = 1.0

    def values(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(x.shape[1])
        for i, (feat, cut, left, value) in enumerate(self.trees):
            v = value[_walk(feat, cut, left, x, self.depth)]
            out += v if self.rate is None else v * (self.rate if i else self.first)
        return out / len(self.trees) if self.rate is None else out

    def predict(self, df: DataFrame, keep=None) -> DataFrame:
        """Add ``pred``; ``keep`` columns are carried through."""
        keep = list(keep) if keep is not None else [c for c in df.columns if c not in self.features]
        ship(df.sparkSession)
        shared, n = df.sparkSession.sparkContext.broadcast(self), len(self.features)

        @F.pandas_udf("double")
        def score(*x: pd.Series) -> pd.Series:
            return pd.Series(shared.value.values(_matrix(pd.concat(x, axis=1), n)))
        return df.select(*keep, score(*[F.col(f).cast("double") for f in self.features]).alias("pred"))

    def thresholds(self) -> dict:
        """Per feature the sorted split points (``x <= t`` goes left): predictions are constant between them."""
        out = {}
        for feat, cut, left, _ in self.trees:
            inner = left != np.arange(len(left))
            for f in np.unique(feat[inner]):
                out.setdefault(self.features[f], set()).update(cut[inner & (feat == f)].tolist())
        return {f: sorted(t) for f, t in out.items()}

    def nested(self) -> list:
        """The trees as nested tuples (feature, point, left, right); a leaf is its value."""
        def at(tree, i):
            feat, cut, left, value = tree
            return float(value[i]) if left[i] == i else (self.features[feat[i]], float(cut[i]), at(tree, left[i]), at(tree, left[i] + 1))
        return [at(t, 0) for t in self.trees]

    @classmethod
    def of_nested(cls, name: str, trees: list, rate, features: list) -> TreeModel:
        out, deepest = [], 0
        for tree in trees:
            t, todo, cuts = Tree(), [(0, tree, 0)], {}
            while todo:
                i, x, level = todo.pop()
                deepest = max(deepest, level)
                if isinstance(x, tuple):
                    left = t.split(i, features.index(x[0]), 0, 0.0, 0.0)
                    cuts[i] = x[1]
                    todo += [(left, x[2], level + 1), (left + 1, x[3], level + 1)]
                else:
                    t.value[i] = x
            feat, _, left, value = t.arrays()
            out.append((feat, np.array([cuts.get(i, np.inf) for i in range(len(feat))]), left, value))
        return cls(name, out, rate, deepest, list(features))


def _with_points(tree, points):
    """Bins to split points; a leaf's is beyond all values."""
    feat, last, left, value = tree
    inner = left != np.arange(len(left))
    cut = np.full(len(feat), np.inf)
    cut[inner] = [points[f][b] for f, b in zip(feat[inner], last[inner])]
    return feat, cut, left, value


def fit_boosting(blocks: Blocks, name: str, rounds: int, max_depth: int, rate: float, checkpoint_every: int = 25) -> list:
    """One boosted model per fit. As in MLlib the first tree is fitted to the label and has weight 1, the
    others to twice the residual, at weight ``rate``."""
    fits = range(len(blocks.fits))
    state, trees = Predictions(blocks), [[] for _ in fits]
    for r in range(rounds):
        target = (lambda fit, y, pred: y) if r == 0 else (lambda fit, y, pred: 2.0 * (y - pred))
        grown = {k: t.arrays() for k, t in grow_trees(state.rdd(), len(blocks.features), fits, max_depth, target, lanes=blocks.lanes).items()}
        state.settled()                     # the tree's first level has filled them
        for k in fits:
            trees[k].append(_with_points(grown[k], blocks.points[k]))
        if r + 1 < rounds:
            state.add(grown, 1.0 if r == 0 else rate, max_depth, (r + 1) % checkpoint_every == 0)
    state.drop()
    return [TreeModel(name, trees[k], rate, max_depth, blocks.features) for k in fits]


# --- forests --------------------------------------------------------------------------------------------------------
def grow_subtree(bins: np.ndarray, weight: np.ndarray, y: np.ndarray, depth: int):
    """The tree of one node's rows, level by level: nodes of more than ``FEW_ROWS`` rows by sums, the others by sorting."""
    w = weight.astype(float)
    made = [(np.zeros(1, np.int16), np.full(1, 65535, np.uint16), np.zeros(1, np.int64), np.array([(w * y).sum() / w.sum()]))]
    size = 1                                      # nodes so far; each level's are added at its end
    at = np.zeros(len(y), np.int64)               # place of a row's node among the open ones
    nodes, rows = np.zeros(1, np.int64), np.arange(len(y))
    for _ in range(depth):
        k = len(nodes)
        if not k:
            break
        found = [np.empty(k), np.empty(k), np.empty(k, np.int64), np.empty(k, np.int64), np.empty(k), np.empty(k)]
        sizes = np.bincount(at, minlength=k)
        if sizes.min() > FEW_ROWS:
            order = None                          # a node's rows are in their order as they are
        else:
            order = np.argsort(at.astype(np.uint16) if k <= 65536 else at, kind="stable")
        starts = np.cumsum(sizes) - sizes
        for least, most in ((0, 4), (4, 8), (8, FEW_ROWS), (FEW_ROWS, len(y))):
            some = np.flatnonzero((sizes > least) & (sizes <= most))
            step = max(1, (1 << 14 if most <= FEW_ROWS else (1 << 22) // MAX_BINS) // max(len(bins), 1))
            for lo in range(0, len(some), step):
                n = some[lo:lo + step]
                if most <= FEW_ROWS:
                    i = np.arange(max(most, 2))
                    r = np.where(i < sizes[n][:, None], rows[order[np.minimum(starts[n][:, None] + i, len(order) - 1)]], -1)
                    best = best_splits_of_few(bins, r, w, y)
                else:
                    if order is None and len(n) == k:
                        r, node = rows, at
                    else:
                        if order is None:
                            order = np.argsort(at, kind="stable")
                        r = rows[order[np.repeat(starts[n] - np.cumsum(sizes[n]) + sizes[n], sizes[n]) + np.arange(sizes[n].sum())]]
                        node = np.repeat(np.arange(len(n)), sizes[n])
                    whole = len(r) == len(y) and len(made) == 1
                    best = best_splits(_sums(bins if whole else bins[:, r], node, len(n), w if whole else w[r], y if whole else y[r], MAX_BINS))
                for a, v in zip(found, best):
                    a[n] = v
        nw, ns, f, b, wl, sl = found
        split = np.flatnonzero(f >= 0)
        left = np.full(k, -1, np.int64)
        left[split] = size + 2 * np.arange(len(split))
        for a, v in zip(made[-1], (f, b, left)):      # the open nodes are among the newest
            a[nodes[split] - (size - len(made[-1][0]))] = v[split]
        new = np.arange(size, size + 2 * len(split))
        weights = np.stack([wl[split], nw[split] - wl[split]], axis=1).ravel()
        values = np.stack([sl[split], ns[split] - sl[split]], axis=1).ravel() / weights
        made.append((np.zeros(len(new), np.int16), np.full(len(new), 65535, np.uint16), new, values))
        going = left[at] >= 0
        if not going.all():
            rows, at = rows[going], at[going]
        child = left[at] + (bins[f[at], rows] > b[at]) - size
        # children of one row's weight are leaves
        open_ones = weights > 1
        if not open_ones.all():
            heavy = open_ones[child]
            rows, child = rows[heavy], child[heavy]
        nodes, at = new[open_ones], (np.cumsum(open_ones) - 1)[child]
        size += len(new)
    return tuple(np.concatenate(a) for a in zip(*made))


@dataclass
class DeepForest:
    """A forest whose subtrees stay on the executors; rows are sent to them to be scored."""
    name: str
    tops: list                       # arrays of each tree's upper part, by bins
    top_depth: int
    fit: int                         # which of the fits
    waves: list                      # (RDD of (fit, tree, node) and arrays, as dealt by ``place``; the wave's trees)
    place: object
    points: list
    depth: int
    features: list

    def predict(self, df: DataFrame, keep=None) -> DataFrame:
        """Add ``pred``; ``keep`` columns are carried through."""
        keep = list(keep) if keep is not None else [c for c in df.columns if c not in self.features]
        spark, n, points, tops, depth = df.sparkSession, len(self.features), self.points, self.tops, self.depth
        top_depth, fit = self.top_depth, self.fit
        base = materialize(df.withColumn("_row", F.monotonically_increasing_id()))
        x = base.select(*[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(self.features)], "_row")

        def to_bins(it):
            for pdf in it:
                yield pd.DataFrame({"block": [pickle.dumps((_bin(_matrix(pdf, n), points), pdf["_row"].to_numpy()), protocol=5)]})

        def routed(trees):
            def route(it):
                for r in it:
                    bins, ids = pickle.loads(r.block)
                    for t in trees:
                        feat, cut, left, _ = tops[t]
                        for node, use in _by_node(_walk(feat, cut, left, bins, top_depth)):
                            yield (fit, t, node), (bins[:, use], ids[use])
            return route

        def scored(it):
            trees, rows = {}, []
            for key, v in it:
                if len(v) == 4:
                    trees[key] = v
                else:
                    rows.append((key, v))
            for key, (bins, ids) in rows:
                feat, cut, left, value = trees[key]
                yield pickle.dumps((ids, value[_walk(feat, cut, left, bins, depth)]), protocol=5)

        def flat(it):
            for pdf in it:
                for b in pdf["block"]:
                    ids, v = pickle.loads(b)
                    yield pd.DataFrame({"_row": ids, "pred": v})
        blocks, votes = x.mapInPandas(to_bins, "block binary").rdd, []
        for subtrees, trees in self.waves:
            # dealt as the subtrees are: these stay where they are
            sent = blocks.mapPartitions(routed(trees)).partitionBy(subtrees.getNumPartitions(), self.place)
            votes.append(subtrees.union(sent).mapPartitions(scored))
        votes = spark.sparkContext.union(votes).map(lambda b: (bytearray(b),))
        votes = spark.createDataFrame(votes, "block binary").mapInPandas(flat, "_row long, pred double")
        mean = votes.groupBy("_row").agg((F.sum("pred") / F.lit(float(len(tops)))).alias("pred"))
        return base.join(mean, "_row").select(*keep, "pred")

    def thresholds(self) -> None:
        """Too many to be held at once."""
        return None


def _compact(tree):
    """A tree by bins in 14 bytes a node, as far as its features and nodes allow."""
    feat, last, left, value = tree
    small = lambda a, least, kind: a.astype(kind) if a.max() <= least else a
    return small(feat, 255, np.uint8), np.minimum(last, 255).astype(np.uint8), small(left, 2 ** 31 - 2, np.int32), value


def _by_node(at: np.ndarray, among=None):
    """(node, its rows in their order) of every node, or of those ``among`` the rows alone."""
    rows = np.arange(len(at)) if among is None else among
    at = at[rows]
    rows = rows[np.argsort(at.astype(np.uint16) if len(at) and at.max() < 65536 else at, kind="stable")]
    nodes, sizes = np.unique(at, return_counts=True)
    return zip(nodes.tolist(), np.split(rows, np.cumsum(sizes)[:-1]))


def fit_forest(blocks: Blocks, name: str, n_trees: int, max_depth: int, bootstrap: bool = True,
               subtree_rows: int = SUBTREE_ROWS) -> list:
    """One forest per fit; every tree sees all features, and rows drawn with replacement if ``bootstrap``."""
    fits = range(len(blocks.fits))
    whole = bootstrap or n_trees == 1
    grown = n_trees if whole else 1                 # without draws all trees are one
    trees = {(k, t): Tree() for k in fits for t in range(grown)}
    open_nodes = {(k, t): [0] for k, t in trees if blocks.counts[k] > subtree_rows}
    small, whole_sets = {}, {}      # whole_sets: per fit the first of its tasks and their number
    little = [k for k in fits if blocks.counts[k] <= subtree_rows]
    tasks = min(grown, max(1, -(-2 * blocks.rdd.context.defaultParallelism // max(len(little), 1))))
    for i, k in enumerate(little):
        whole_sets[k] = (i * tasks, tasks)
    level = 0
    while level < max_depth and any(open_nodes.values()):
        children = _grow_level(trees, _level(blocks.rdd, len(blocks.features), trees, level, open_nodes,
                                             lambda fit, y, pred: y, bootstrap, lanes=blocks.lanes))
        level += 1
        open_nodes = {}
        for k, nodes in children.items():
            open_nodes[k] = [c for c, w in nodes.items() if w > subtree_rows]
            small.setdefault(k, set()).update(c for c, w in nodes.items() if w <= subtree_rows)
    tops = {k: t.arrays() for k, t in trees.items()}
    rest, top_depth = max_depth, level
    # levels left below each node that one task finishes
    levels = {k: _depths(t) for k, t in tops.items()}
    cores, row = blocks.rdd.context.defaultParallelism, len(blocks.features) + 9
    waves, room = [], 0             # of about WAVE_BYTES each: the trees, one after another, of all fits
    for t in range(grown):
        size = sum(blocks.counts[k] for k in fits if k not in whole_sets) * row
        if not waves or size > room:
            waves.append([])
            room = WAVE_BYTES
        waves[-1].append(t)
        room -= size

    def sender(trees_now, with_whole_sets):
        def send(it):
            for fit, bins, y, _, key in it:
                if fit in whole_sets:
                    for i in range(tasks if with_whole_sets else 0):
                        yield (fit, -1, i), (bins, key, y)
                    continue
                for t in trees_now:
                    if (fit, t) not in small:
                        continue
                    feat, cut, left, _ = tops[fit, t]
                    w = _draws(key, t) if bootstrap else np.ones(len(y), np.uint8)
                    wanted = np.zeros(len(feat), bool)
                    wanted[list(small[fit, t])] = True
                    at = _walk(feat, cut, left, bins, top_depth)
                    for node, use in _by_node(at, np.flatnonzero(wanted[at] & (w > 0))):
                        yield (fit, t, node), (bins[:, use], w[use], y[use])
        return send

    def finish(it):
        held = {}
        for key, v in it:
            held.setdefault(key, []).append(v)
        while held:
            (k, t, node), chunks = held.popitem()
            bins, w, y = (np.concatenate(c, axis=-1) for c in zip(*chunks))
            if t < 0:               # a whole set, with its keys: this task's share of the trees
                for t in range(node, grown, tasks):
                    n = _draws(w, t) if bootstrap else np.ones(len(y), np.uint8)
                    use = n > 0
                    yield (k, t, 0), grow_subtree(bins[:, use], n[use], y[use], rest) if use.any() else Tree().arrays()
                continue
            yield (k, t, node), grow_subtree(bins, w, y, rest - int(levels[k, t][node]))

    def place(key):
        k, t, node = key
        return whole_sets[k][0] + (node if t < 0 else t % tasks) if k in whole_sets else portable_hash(key)
    deep, found, held = max_depth > DRIVER_DEPTH, {}, []
    for i, wave in enumerate(waves):
        shipped = sum(blocks.counts[k] for k in fits if k not in whole_sets) * len(wave) * row
        wide = max(cores, min(-(-shipped // (1 << 26)), 4096), 0 if i else len(little) * tasks)
        sent = blocks.rdd.mapPartitions(sender(wave, not i)).partitionBy(wide, place)
        done = sent.mapPartitions(finish, preservesPartitioning=True)
        if deep:
            done = done.map(lambda x: (x[0], _compact(x[1])), preservesPartitioning=True)
            trees_of = {k: [*range(grown)] if k in whole_sets and not i else [] if k in whole_sets else wave for k in fits}
            closed = [((k, t, n), (np.zeros(1, np.int16), np.full(1, 65535, np.uint16), np.zeros(1, np.int64), tops[k, t][3][n:n + 1]))
                      for k in fits if k not in whole_sets for t in wave
                      for n in np.flatnonzero(tops[k, t][2] == np.arange(len(tops[k, t][2]))).tolist() if n not in small.get((k, t), ())]
            leaves = blocks.rdd.context.parallelize(closed, 1).partitionBy(wide, place)
            done = done.union(leaves).persist(StorageLevel.MEMORY_AND_DISK)
            done.count()
            held.append((done, trees_of))
        else:
            for (k, t, node), sub in done.collect():        # at most 2 ^ DRIVER_DEPTH nodes a tree
                found.setdefault((k, t), []).append((node, sub))
        delete_shuffle(sent)
    if deep:
        return [DeepForest(name, [tops[k, t] for t in range(grown)], top_depth, k, [(done, of[k]) for done, of in held if of[k]], place,
                           blocks.points[k], max_depth, blocks.features) for k in fits]
    out = []
    for k in fits:
        made = [_with_points(_attached(tops[k, t], found.get((k, t), ())), blocks.points[k]) for t in range(grown)]
        out.append(TreeModel(name, made if whole else made * n_trees, None, max_depth, blocks.features))
    return out


def _depths(tree) -> np.ndarray:
    """Depth of every node; children come after their parents."""
    left = tree[2]
    out = np.zeros(len(left), np.int64)
    for i in range(len(left)):
        if left[i] != i:
            out[left[i]] = out[left[i] + 1] = out[i] + 1
    return out


def _attached(top, subtrees):
    """The upper part of a tree with its subtrees in the place of its leaves."""
    feat, cut, left, value = ([a] for a in top)
    feat, cut, left, value = feat[0].copy(), cut[0].copy(), left[0].copy(), value[0].copy()
    more, at = [], len(feat)
    for node, (f, c, l, v) in subtrees:
        feat[node], cut[node], value[node] = f[0], c[0], v[0]
        # the subtree's root takes the leaf's place, its other nodes follow
        shifted = l + at - 1
        left[node] = node if l[0] == 0 else shifted[0]
        more.append((f[1:], c[1:], shifted[1:], v[1:]))
        at += len(f) - 1
    return tuple(np.concatenate([a, *[m[i] for m in more]]) for i, a in enumerate((feat, cut, left, value)))


def fit_learner(blocks: Blocks, name: str, n_trees: int = 100, rf_depth: int = 30, rounds: int = 100, bootstrap: bool = True) -> list:
    """One model per fit of a named learner; tree counts, depth and rounds are parameters."""
    if name == "Random Forest":
        return fit_forest(blocks, name, n_trees, rf_depth, bootstrap)
    if name == "Gradient Boosting":
        return fit_boosting(blocks, name, rounds, 3, 0.1)
    if name == "Boosted Trees (deep)":
        return fit_boosting(blocks, name, rounds, 6, 0.3)
    raise ValueError(f"unknown model {name!r}")
