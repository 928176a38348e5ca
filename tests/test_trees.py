"""Binned trees: against a plain greedy fit, over partitions, folds side by side, and forests at any depth."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from outletlens.ml import trees
from outletlens.ml.models import fit_model

XS = ["x1", "x2", "x3"]


def table(spark, n=400):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 20, size=(n, 3)).astype(float)
    y = x[:, 0] * 2 - x[:, 1] + np.where(x[:, 2] > 9, 5.0, 0.0) + rng.normal(size=n)
    rows = [(i, *map(float, r), float(t), i % 3) for i, (r, t) in enumerate(zip(x, y))]
    return x, y, spark.createDataFrame(rows, "id int, x1 double, x2 double, x3 double, label double, fold int")


def greedy(x, y, depth):
    out = np.full(len(y), y.mean())
    best = (1e-9, None)
    for f in range(x.shape[1]):
        for p in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= p
            gain = ((y - y.mean()) ** 2).sum() - sum(((y[s] - y[s].mean()) ** 2).sum() for s in (left, ~left))
            if gain > best[0] + 1e-9:
                best = (gain, left)
    if depth and best[1] is not None:
        for s in (best[1], ~best[1]):
            out[s] = greedy(x[s], y[s], depth - 1)
    return out


def preds(model, df):
    return np.array([r.pred for r in model.predict(df, keep=["id"]).orderBy("id").collect()])


def boosted(x, y, rounds, depth, rate):
    pred = greedy(x, y, depth)
    for _ in range(rounds - 1):
        pred = pred + rate * greedy(x, 2 * (y - pred), depth)
    return pred


def test_boosting_equals_a_greedy_fit_on_any_partitions_and_all_folds_at_once(spark):
    x, y, df = table(spark)
    for part in (df.coalesce(1), df.repartition(5)):
        assert np.allclose(preds(fit_model("Gradient Boosting", part, XS, rounds=4), df), boosted(x, y, 4, 3, 0.1), atol=1e-8)
    blocks = trees.binned(df, XS, [None, 0, 1, 2])
    both = trees.fit_boosting(blocks, "b", 3, 3, 0.1, checkpoint_every=2)
    for held, model in zip([None, 0, 1, 2], both):
        rest = df if held is None else df.where(F.col("fold") != held)
        ids = np.arange(len(y)) if held is None else np.flatnonzero(np.arange(len(y)) % 3 != held)
        assert np.allclose(preds(model, rest), boosted(x[ids], y[ids], 3, 3, 0.1), atol=1e-8)


def test_a_forest_is_the_same_whether_nodes_are_split_by_sums_or_by_one_task(spark):
    x, y, df = table(spark)
    blocks = trees.binned(df, XS)
    one, some, none = (trees.fit_forest(blocks, "f", 3, 6, subtree_rows=r)[0] for r in (10_000, 60, 0))
    assert np.allclose(preds(one, df), preds(some, df), atol=1e-9) and np.allclose(preds(one, df), preds(none, df), atol=1e-9)
    plain = trees.fit_forest(blocks, "f", 3, 4, bootstrap=False)[0]
    assert np.allclose(preds(plain, df), greedy(x, y, 4), atol=1e-9)
    again = trees.fit_forest(trees.binned(df.repartition(7), XS), "f", 3, 6)[0]
    assert np.allclose(preds(one, df), preds(again, df), atol=1e-9)        # draws do not depend on partitions


def test_a_deep_forest_scores_rows_where_its_subtrees_are(spark, monkeypatch):
    _, _, df = table(spark)
    want = preds(trees.fit_forest(trees.binned(df, XS), "f", 4, 8)[0], df)
    monkeypatch.setattr(trees, "DRIVER_DEPTH", 3)
    for rows in (10_000, 60):
        deep = trees.fit_forest(trees.binned(df, XS), "f", 4, 8, subtree_rows=rows)[0]
        assert isinstance(deep, trees.DeepForest) and np.allclose(preds(deep, df), want, atol=1e-9)


def test_draws_are_poisson_and_differ_between_trees_and_equal_rows(spark):
    key = np.random.default_rng(1).integers(0, 2 ** 63, 50_000).astype(np.uint64)
    a, b = trees._draws(key, 0), trees._draws(key, 1)
    assert abs(a.mean() - 1) < 0.02 and abs((a == 0).mean() - np.exp(-1)) < 0.01 and (a != b).mean() > 0.5
    twins = spark.range(300).selectExpr("1D AS x1", "2D AS label")
    drawn = trees.binned(twins.coalesce(1), ["x1"]).rdd.map(lambda b: trees._draws(b[4], 0)).collect()
    assert len(set(np.concatenate(drawn).tolist())) > 1


def test_null_features_and_no_rows_are_errors(spark):
    _, _, df = table(spark, 30)
    with pytest.raises(ValueError):
        fit_model("Gradient Boosting", df.where("false"), XS, rounds=2)
    with pytest.raises(Exception, match="NULL or NaN"):
        fit_model("Gradient Boosting", df.withColumn("x1", F.lit(None).cast("double")), XS, rounds=2)


def test_blocks_of_a_single_file_are_dealt_over_all_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    df = spark.range(3000 * cores).selectExpr("cast(id % 7 as double) AS x1", "cast(id as double) AS label", "cast(id % 2 as int) AS fold").coalesce(1)
    for fits in ([None], [None, 0, 1]):
        blocks = trees.binned(df, ["x1"], fits)
        held = blocks.rdd.mapPartitions(lambda it: [[(b[0], len(b[2])) for b in it]]).collect()
        assert blocks.lanes * len(fits) >= cores and len(held) == blocks.lanes * len(fits) and all(held)
        assert all(len({fit for fit, _ in part}) == 1 for part in held)        # one table of sums a partition
        assert [sum(n for part in held for fit, n in part if fit == k) for k in range(len(fits))] == blocks.counts
        blocks.unpersist()


def test_nodes_of_few_rows_split_as_by_their_sums():
    rng = np.random.default_rng(6)
    for rows in (2, 3, 9, 16):
        n = 40 * rows
        bins, w, y = rng.integers(0, 5, (3, n)).astype(np.uint8), rng.integers(1, 4, n).astype(float), rng.normal(size=n)
        y[:rows] = 2.0                                                          # a node that no split gains on
        at = np.repeat(np.arange(40), rows)
        want = trees.best_splits(trees._sums(bins, at, 40, w, y, trees.MAX_BINS))
        got = trees.best_splits_of_few(bins, np.arange(n).reshape(40, rows), w, y)
        split = want[2] >= 0
        assert not split[0] and split.sum() > 30 and np.array_equal(want[2], got[2])
        assert np.allclose(want[0], got[0]) and all(np.array_equal(a[split], b[split]) for a, b in zip(want[1:], got[1:]))


def shuffle_files(spark):
    """Names of the shuffles whose files lie in this session's local folders."""
    import os
    import re
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {m.group() for top in folders for _, _, names in os.walk(top) for f in names if (m := re.match(r"shuffle_\d+", f))}


def test_trees_of_a_forest_go_in_waves_that_leave_no_shuffle_files(spark, monkeypatch):
    _, _, df = table(spark)
    blocks = trees.binned(df, XS, [None, 0])
    blocks.rdd.count()
    want = [preds(m, df) for m in trees.fit_forest(blocks, "f", 5, 6, subtree_rows=60)]
    waves, delete = [], trees.delete_shuffle

    def counted(shuffled):
        before = shuffle_files(spark)
        delete(shuffled)
        waves.append(before - shuffle_files(spark))
    monkeypatch.setattr(trees, "delete_shuffle", counted)
    monkeypatch.setattr(trees, "WAVE_BYTES", 1)
    for deepest in (12, 3):
        monkeypatch.setattr(trees, "DRIVER_DEPTH", deepest)
        del waves[:]
        found = trees.fit_forest(blocks, "f", 5, 6, subtree_rows=60)
        assert len(waves) == 5 and all(len(gone) == 1 for gone in waves)
        assert all(np.allclose(preds(m, df), w, atol=1e-9) for m, w in zip(found, want))


def test_a_booster_keeps_predictions_beside_the_blocks_and_its_last_checkpoint_alone(spark, monkeypatch):
    import glob
    _, _, df = table(spark)
    blocks = trees.binned(df, XS, [None, 0])
    written = lambda: set(glob.glob(f"{spark.sparkContext.getCheckpointDir().removeprefix('file:')}/rdd-*"))
    before, most, held, settled = written(), [0], [], trees.Predictions.settled

    def watched(self):
        settled(self)
        most.append(len(written() - before))
        if self.held is not None:
            held.append(self.held.map(lambda p: p.nbytes).sum())
    monkeypatch.setattr(trees.Predictions, "settled", watched)
    trees.fit_boosting(blocks, "b", 6, 2, 0.1, checkpoint_every=1)
    assert max(most) == 1 and written() == before
    assert set(held) == {8 * sum(blocks.counts)}


def test_nodes_of_one_task_are_placed_where_its_rows_are():
    rng = np.random.default_rng(8)
    at = rng.integers(0, 7, 300)
    among = np.flatnonzero(at > 2)
    assert {n: u.tolist() for n, u in trees._by_node(at, among)} == {n: np.flatnonzero(at == n).tolist() for n in range(3, 7)}
    assert len([*trees._by_node(at)]) == 7
