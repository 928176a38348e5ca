"""Regularised gradient boosting for squared error (M8): second-order gain with an L2 term.

A round grows one tree level by level. For squared error a row's gradient is ``g = F - y`` and
its second derivative 1, so a node is known by ``G = sum(g)`` and ``H = count``. A split's gain is
``(GL^2/(HL+l) + GR^2/(HR+l) - G^2/(H+l)) / 2 - gamma`` and a leaf adds ``-rate * G / (H+l)``, where
``l`` is ``reg_lambda``.

* Split points are at most ``max_bins - 1`` quantiles of each feature, from one aggregate of sketches;
  ``x < point`` goes left, NULL too. A value rarer than ``1 / max_bins`` may share a bin with its
  neighbour. Rows are binned once, into the blocks of :mod:`.trees`, dealt over all cores.
* One level is one job: a task sums its blocks by (node, feature, bin), running sums over a feature's bins give every
  candidate's gain, and one best split a node is kept. What is shuffled is one table of nodes x features x bins a
  task, however many rows there are. ``best_splits`` states the same level in SQL, over rows with an array of bins;
  tests hold the two against each other.
* Ties go to the first feature, then to the lowest point. A node without a gain above ``MIN_GAIN`` is a leaf.
* ``F`` is kept per round, beside the blocks; a reliable checkpoint every ``checkpoint_every`` rounds cuts its lineage.

Rows without a label are left out; without any other row fitting raises ``ValueError``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import FEATURES
from . import trees

NAME = "Regularised Boosting"
MIN_GAIN = 1e-6          # a split must win more than this
SKETCH_ACCURACY = 10_000  # rank error of the split points: at most rows / 10,000


def _sql(x: float) -> str:
    """A double as SQL text, every bit of it."""
    return f"CAST('{float(x)!r}' AS DOUBLE)"


def _literals(values) -> str:
    return f"array({', '.join(map(str, values))})"


@dataclass
class BoostedModel:
    """Trees are nested: a leaf is its value, an inner node (feature, point, left, right)."""
    name: str
    init: float
    trees: list = field(default_factory=list)
    features: list = field(default_factory=lambda: list(FEATURES))

    def _value(self, tree) -> str:
        if not isinstance(tree, tuple):
            return _sql(tree)
        f, point, left, right = tree
        return f"IF(`{f}` >= {_sql(point)}, {self._value(right)}, {self._value(left)})"

    def predict(self, df: DataFrame, keep=None) -> DataFrame:
        """Add ``pred``; ``keep`` columns are carried through. One projection, no Python in it: the trees'
        values are folded, since a sum of all trees passes the size that generated code may have."""
        keep = list(keep) if keep is not None else [c for c in df.columns if c not in self.features]
        pred = F.lit(float(self.init))
        if self.trees:
            pred = F.aggregate(F.array(*[F.expr(self._value(t)) for t in self.trees]), pred, lambda a, v: a + v)
        return df.select(*keep, pred.alias("pred"))

    def thresholds(self) -> dict:
        """Per feature the sorted split points: predictions are constant between them."""
        out: dict = {}

        def walk(tree):
            if isinstance(tree, tuple):
                out.setdefault(tree[0], set()).add(float(tree[1]))
                walk(tree[2])
                walk(tree[3])
        for tree in self.trees:
            walk(tree)
        return {f: sorted(points) for f, points in out.items()}


def split_points(train: DataFrame, features, max_bins: int) -> list:
    """Per feature its candidate split points, ascending; none for a constant feature."""
    shares = [i / max_bins for i in range(1, max_bins)]
    row = train.agg(*[F.percentile_approx(F.col(f).cast("double"), shares, SKETCH_ACCURACY).alias(f"q{i}")
                      for i, f in enumerate(features)],
                    *[F.min(F.col(f).cast("double")).alias(f"m{i}") for i, f in enumerate(features)],
                    *[F.max(F.col(f).cast("double")).alias(f"x{i}") for i, f in enumerate(features)]).first()
    out = []
    for i in range(len(features)):
        points = {*(row[f"q{i}"] or []), *([row[f"x{i}"]] if row[f"x{i}"] is not None else [])}
        # a point at the minimum still parts NULLs from values
        out.append(sorted(points) if row[f"m{i}"] is not None else [])
    return out


def _place(splits: dict, depth: int) -> str:
    """SQL of a row's node under the splits so far, by heap numbers from 1 (left 2k, right 2k + 1).

    The splits are array literals that a fold walks down, so every level of every tree runs the same
    compiled plan. A node without a split keeps its rows."""
    size = max(splits, default=0) + 1
    feature = _literals(splits[k][0] if k in splits else -1 for k in range(size))
    last = _literals(splits[k][1] if k in splits else 0 for k in range(size))
    return (f"aggregate(array_repeat(0, {depth}), 1, (k, x) -> IF(coalesce(get({feature}, k), -1) < 0, k, "
            f"2 * k + CAST(get(bins, get({feature}, k)) > get({last}, k) AS INT)))")


def best_splits(data: DataFrame, node: str, open_nodes, reg_lambda: float, gamma: float, min_child: float) -> DataFrame:
    """One level: per open node and feature the node's sums (G, H) and the feature's best split
    (gain, bin, GL, HL), NULL if none. Stated as SQL text: a round of levels is otherwise mostly plan building."""
    hist = (data.selectExpr(f"{node} AS node", "F - label AS g", "bins")
            .where(f"array_contains({_literals(sorted(open_nodes))}, node)")
            .selectExpr("node", "g", "posexplode(bins) AS (feature, bin)")
            .groupBy("node", "feature", "bin").agg(F.expr("sum(g) AS g"), F.expr("count(1) AS h")))
    over = "OVER (PARTITION BY node, feature"
    upto = f"{over} ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    sums = hist.selectExpr("node", "feature", "bin", f"sum(g) {upto} AS GL", f"sum(h) {upto} AS HL", f"sum(g) {over}) AS G", f"sum(h) {over}) AS H")
    lam, least = _sql(reg_lambda), _sql(min_child)
    gain = (f"0.5D * (GL * GL / (HL + {lam}) + (G - GL) * (G - GL) / (H - HL + {lam}) - G * G / (H + {lam})) - {_sql(gamma)}")
    # only allowed splits are scored: with no penalty an empty side would divide by zero
    scored = sums.selectExpr("*", f"CASE WHEN H > HL AND HL >= {least} AND H - HL >= {least} THEN {gain} END AS gain")
    # per (node, feature) on the window's own partitioning: no further shuffle
    top = f"max(CASE WHEN gain > {_sql(MIN_GAIN)} THEN struct(gain, -bin AS b, GL, HL) END) AS s"
    return (scored.groupBy("node", "feature").agg(F.expr(top), F.expr("max(G) AS G"), F.expr("max(H) AS H"))
            .selectExpr("node", "feature", "G", "H", "s.gain", "CAST(-s.b AS INT) AS bin", "s.GL", "s.HL"))


def best_of(reg_lambda: float, gamma: float, min_child: float):
    """``best_splits`` of one node's table of sums (feature, bin, [H, G]), as ``trees.best_splits`` returns it."""
    def score(sums):
        run = np.cumsum(sums, axis=2)
        h, g = run[:, :, -1, 0], run[:, :, -1, 1]
        hl, gl = run[:, :, :-1, 0], run[:, :, :-1, 1]
        hr, gr = h[:, :, None] - hl, g[:, :, None] - gl
        ok = (hl > 0) & (hr > 0) & (hl >= min_child) & (hr >= min_child)
        # only allowed splits are scored: with no penalty an empty side would divide by zero
        gain = 0.5 * (gl * gl / np.where(ok, hl + reg_lambda, 1.0) + gr * gr / np.where(ok, hr + reg_lambda, 1.0)
                      - (g * g / (h + reg_lambda))[:, :, None]) - gamma
        flat = np.where(ok & (gain > MIN_GAIN), gain, -np.inf).reshape(len(h), -1)
        best, i = flat.argmax(axis=1), np.arange(len(h))        # the first feature, then the lowest point
        f, b = np.divmod(best, gain.shape[2])
        return h[:, 0], g[:, 0], np.where(flat[i, best] == -np.inf, -1, f), b, hl[i, f, b], gl[i, f, b]
    return score


def fit_boosted(train: DataFrame, features=FEATURES, rounds: int = 100, max_depth: int = 6, rate: float = 0.3,
                reg_lambda: float = 1.0, gamma: float = 0.0, min_child: float = 1.0, max_bins: int = 64,
                checkpoint_every: int = 10, name: str = NAME) -> BoostedModel:
    """Fit on ``train`` (flat feature columns + ``label``)."""
    if not 1 <= max_depth <= 12 or not 2 <= max_bins <= 4096:
        raise ValueError("max_depth must be 1 to 12 and max_bins 2 to 4096")
    features = list(features)
    train = train.where(F.col("label").isNotNull())
    init, n = train.agg(F.avg("label"), F.count(F.lit(1))).first()
    if init is None:
        raise ValueError("no rows with a label to fit on")
    points = split_points(train, features, max_bins)
    values = [F.coalesce(F.col(f).cast("double"), F.lit(float("-inf"))) for f in features]
    blocks = trees.in_blocks(trees.flat_rows(train, values, features, None), features, [None], [[np.array(p) for p in points]],
                             [n], [float(init)], side="right")
    model = BoostedModel(name, float(init), features=features)
    leaf = lambda h, g: -rate * g / (h + reg_lambda) if h + reg_lambda else 0.0
    how = dict(n_bins=max(2, *[len(p) + 1 for p in points]), score=best_of(reg_lambda, gamma, min_child), lanes=blocks.lanes)
    state = trees.Predictions(blocks)

    def nested(tree, at=0):
        if tree.left[at] == at:
            return float(tree.value[at])
        f, left = tree.feat[at], tree.left[at]
        return (features[f], points[f][tree.bin[at]], nested(tree, left), nested(tree, left + 1))

    for r in range(rounds):
        tree = trees.grow_trees(state.rdd(), len(features), [0], max_depth, lambda fit, y, pred: pred - y, leaf, **how)[0]
        state.settled()                 # the tree's first level has filled them
        model.trees.append(nested(tree))
        if len(tree.left) == 1 and tree.value[0] == 0.0:
            break                       # nothing left to learn, and nothing would change in later rounds
        if r + 1 < rounds:
            state.add({0: tree.arrays()}, 1.0, max_depth, (r + 1) % checkpoint_every == 0)
    state.drop()
    blocks.unpersist()
    return model
