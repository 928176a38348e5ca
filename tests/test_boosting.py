"""Regularised boosting against a plain greedy reference on the same split points."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from outletlens.ml.boosting import BoostedModel, fit_boosted
from outletlens.ml.models import fit_model


def greedy(x, y, rounds, depth, rate, lam, gamma, min_child):
    """Brute force: every value of every feature as a point, NaN (= NULL) goes left."""
    x = np.where(np.isnan(x), -np.inf, x)
    pred = np.full(len(y), y.mean())

    def grow(rows, level):
        g = pred[rows] - y[rows]
        best = (1e-6, None)
        for f in range(x.shape[1]):
            for p in np.unique(x[rows, f]):
                left = x[rows, f] < p
                a, b = left.sum(), (~left).sum()
                if level == depth or min(a, b) < max(min_child, 1):
                    continue
                gain = (g[left].sum() ** 2 / (a + lam) + g[~left].sum() ** 2 / (b + lam) - g.sum() ** 2 / (len(g) + lam)) / 2 - gamma
                if gain > best[0] + 1e-9:
                    best = (gain, left)
        if best[1] is None:
            step[rows] = -rate * g.sum() / (len(g) + lam)
            return
        grow(rows[best[1]], level + 1)
        grow(rows[~best[1]], level + 1)

    for _ in range(rounds):
        step = np.zeros(len(y))
        grow(np.arange(len(y)), 0)
        pred = pred + step
    return pred


def table(spark, x, y):
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id int, " + ", ".join(f"x{j} double" for j in range(x.shape[1])) + ", label double")


@pytest.mark.parametrize("features,depth,lam,gamma,min_child", [(1, 3, 1.0, 0.0, 1.0), (3, 4, 5.0, 0.5, 4.0), (2, 2, 0.0, 0.0, 0.0)])
def test_equals_brute_force(spark, features, depth, lam, gamma, min_child):
    rng = np.random.default_rng(features)
    x = rng.integers(0, 12, size=(300, features)).astype(float)
    x[rng.random(x.shape) < 0.1] = np.nan
    y = np.nan_to_num(x).sum(axis=1) ** 1.5 + rng.normal(size=300)
    df = table(spark, x, y)
    names = [f"x{j}" for j in range(features)]
    m = fit_boosted(df, names, rounds=4, max_depth=depth, reg_lambda=lam, gamma=gamma, min_child=min_child,
                    max_bins=1000, checkpoint_every=2)
    got = np.array([r.pred for r in m.predict(df, keep=["id"]).orderBy("id").collect()])
    assert np.allclose(got, greedy(x, y, 4, depth, 0.3, lam, gamma, min_child), rtol=0, atol=1e-8)


def test_partitioning_does_not_matter_and_thresholds_cover_the_trees(spark):
    rng = np.random.default_rng(9)
    x = rng.integers(0, 20, size=(200, 2)).astype(float)
    df = table(spark, x, x[:, 0] * 3 - x[:, 1] + rng.normal(size=200))
    a, b = (fit_boosted(d, ["x0", "x1"], rounds=3, max_depth=3) for d in (df.coalesce(1), df.repartition(7)))
    assert [t[:2] for t in a.trees] == [t[:2] for t in b.trees]
    assert a.thresholds().keys() <= {"x0", "x1"} and all(p == sorted(set(p)) for p in a.thresholds().values())


def test_constant_label_one_row_nulls_and_empty(spark):
    df = table(spark, np.array([[1.0], [2.0], [np.nan]]), np.array([4.0, 4.0, 4.0]))
    m = fit_boosted(df, ["x0"], rounds=5)
    assert m.init == 4.0 and len(m.trees) == 1 and {r.pred for r in m.predict(df, keep=[]).collect()} == {4.0}
    one = fit_boosted(df.where("id = 0"), ["x0"], rounds=2)
    assert [r.pred for r in one.predict(df, keep=["id"]).collect()] == [4.0] * 3
    unlabelled = df.union(df.select("id", "x0", F.lit(None).cast("double")))
    assert fit_boosted(unlabelled, ["x0"], rounds=1).init == 4.0
    all_null = fit_boosted(df.withColumn("x0", F.lit(None).cast("double")), ["x0"], rounds=2)
    assert all_null.thresholds() == {}
    with pytest.raises(ValueError):
        fit_boosted(df.where("false"), ["x0"])
    with pytest.raises(ValueError):
        fit_model("Regularised Boosting", df.withColumn("x0", F.lit(float("inf"))), ["x0"])


def test_the_penalty_shrinks_leaves(spark):
    df = table(spark, np.array([[0.0], [0.0], [1.0], [1.0]]), np.array([0.0, 0.0, 8.0, 8.0]))
    m = fit_boosted(df, ["x0"], rounds=1, rate=1.0, reg_lambda=2.0)
    assert isinstance(m, BoostedModel) and m.trees == [("x0", 1.0, -2.0, 2.0)]
    assert fit_boosted(df, ["x0"], rounds=1, reg_lambda=2.0, gamma=16.0).thresholds() == {}


def test_a_level_is_one_combined_aggregate_without_python(spark):
    from outletlens.ml.boosting import _place, best_splits
    data = spark.range(100).selectExpr("array(cast(id % 3 as smallint)) AS bins", "cast(id as double) AS label", "0D AS F")
    plan = best_splits(data, _place({}, 0), {1}, 1.0, 0.0, 1.0)._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and "Python" not in plan and "Join" not in plan
    assert plan.count("Exchange hashpartitioning") == 2        # by bin, then by feature; the best split needs no third


def test_a_level_on_blocks_equals_its_sql_statement(spark):
    from outletlens.ml import trees
    from outletlens.ml.boosting import _place, best_of, best_splits
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 6, (200, 3)).astype(float), rng.normal(size=200)
    df = table(spark, x, y)
    names, points = ["x0", "x1", "x2"], [np.arange(6.0)] * 3
    rows = best_splits(df.selectExpr("array(x0, x1, x2) AS v", "label").selectExpr(
        "transform(v, e -> cast(e + 1 as smallint)) AS bins", "label", "0D AS F"), _place({}, 0), {1}, 1.0, 0.1, 2.0).collect()
    want = min(rows, key=lambda r: (-r.gain, r.feature))
    blocks = trees.in_blocks(trees.flat_rows(df, [F.col(c) for c in names], names, None), names, [None], [points], [200], [0.0], side="right")
    found = trees._level(blocks.rdd, 3, {(0, 0): trees.Tree()}, 0, {(0, 0): [0]}, lambda fit, y, pred: pred - y, False,
                         n_bins=7, score=best_of(1.0, 0.1, 2.0))[0, 0][0]
    h, g, f, b, hl, gl = found
    assert (f, b, h, hl) == (want.feature, want.bin, want.H, want.HL) and np.allclose([g, gl], [want.G, want.GL])
    assert blocks.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism       # whatever files the rows came in
