import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import SF_SMALL
from outletlens.ml import linear
from outletlens.ml.models import fit_model, train_and_evaluate
from outletlens.plans.catalog import prepared_table
from outletlens.schema import FEATURES

XS = ["x1", "x2", "x3"]


def table(spark, n=300, seed=3, dependent=False, shift=0.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1.0, 1000.0, 0.01] + shift
    if dependent:
        x[:, 2] = 2 * x[:, 0] - x[:, 1]
    y = x @ [2.0, -0.5, 30.0] + rng.normal(size=n)
    rows = [(i, 1998, 1, *map(float, r), float(t), i % 5, i % 7 == 0) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "RestaurantID long, Yr int, Mo int, x1 double, x2 double, x3 double, label double, fold int, is_test boolean")
    return df, x, y


def numpy_predictions(x, y, rows):
    design = np.c_[np.ones(len(x)), x - x.mean(0)]
    w = np.linalg.lstsq(design[rows], y[rows], rcond=1e-12)[0]
    return design @ w


@pytest.mark.parametrize("dependent,shift", [(False, 0.0), (False, 1e5), (True, 0.0)])
def test_every_fold_equals_least_squares_on_the_other_folds(spark, dependent, shift):
    df, x, y = table(spark, dependent=dependent, shift=shift)
    whole, by_fold = linear.fit_folds(df, XS)
    got = {r.RestaurantID: r.pred for r in whole.predict(df, keep=["RestaurantID"]).collect()}
    assert np.allclose([got[i] for i in range(len(x))], numpy_predictions(x, y, np.arange(len(x))), rtol=1e-6, atol=1e-5)
    held = linear.held_out_predictions(df, by_fold, keep=["RestaurantID"]).collect()
    assert len(held) == len(x)
    fold = np.arange(len(x)) % 5
    want = {f: numpy_predictions(x, y, np.flatnonzero(fold != f)) for f in range(5)}
    assert np.allclose([r.pred for r in held], [want[r.fold][r.RestaurantID] for r in held], rtol=1e-6, atol=1e-5)


def test_equals_the_mllib_fits_and_beats_them_on_dependent_features(spark):
    train = prepared_table(spark, SF_SMALL).where(~F.col("is_test")).persist()
    keep = ["RestaurantID", "Yr", "Mo"]
    free = ["AOV", "DeliveryRadiusKM", "CommissionRate", "InStoreShare", "GrowthFactor", "MonthlyOrders", "Segment_enc"]
    spread = train.agg(F.stddev("label")).first()[0]
    whole, by_fold = linear.fit_folds(train, free)
    for f, m in [(None, whole), (0, by_fold[0]), (4, by_fold[4])]:
        rows = train if f is None else train.where(F.col("fold") != f)
        other = fit_model("Linear Regression", rows, free)
        both = m.predict(rows, keep=keep).join(other.predict(rows, keep=keep).withColumnRenamed("pred", "o"), keep)
        assert both.agg(F.max(F.abs(F.col("pred") - F.col("o")))).first()[0] < 1e-6 * spread
    # all features hold exact dependences (shares, totals): MLlib only comes near the optimum there
    rows = train.toPandas()
    x, y = rows[list(FEATURES)].to_numpy(float), rows.label.to_numpy()
    x = (x - x.mean(0)) / np.where(x.std(0) == 0, 1, x.std(0))
    whole, by_fold = linear.fit_folds(train, FEATURES)
    for f, m in [(None, whole), *by_fold.items()]:
        used = np.flatnonzero((rows.fold != f).to_numpy()) if f is not None else np.arange(len(rows))
        got = train.where(F.col("fold") != f) if f is not None else train
        got = m.predict(got, keep=[*keep, "label"]).toPandas().sort_values(keep).pred.to_numpy()
        order = rows.iloc[used].sort_values(keep).index.to_numpy()
        assert np.allclose(got, numpy_predictions(x, y, used)[order], rtol=0, atol=1e-6 * spread)
    train.unpersist()


def test_training_report_uses_them_and_two_scans(spark):
    df, x, y = table(spark)
    fitted, preds, metrics = train_and_evaluate(df, models=["Linear Regression"], features=XS)
    assert isinstance(fitted["Linear Regression"], linear.LinearModel)
    row = metrics.first()
    fold = np.arange(len(x)) % 5
    tr = np.arange(len(x)) % 7 != 0
    rmse = [np.sqrt(np.mean((y - numpy_predictions(x, y, np.flatnonzero(tr & (fold != f))))[tr & (fold == f)] ** 2)) for f in range(5)]
    assert np.isclose(row.CV_RMSE_mean, np.mean(rmse)) and np.isclose(row.CV_RMSE_std, np.std(rmse))
    train_and_evaluate(df, models=["Linear Regression"], features=XS, cv=False)


def test_edges(spark):
    df, _, _ = table(spark, 40)
    whole, by_fold = linear.fit_folds(df.withColumn("fold", F.lit(2)), XS)         # one fold holds all rows
    assert by_fold == {2: None}
    assert linear.held_out_predictions(df.withColumn("fold", F.lit(2)), by_fold).where("pred IS NOT NULL").count() == 0
    flat, _ = linear.fit_folds(df.withColumns({c: F.lit(1.0) for c in XS}), XS)    # constant columns: the mean
    mean = df.agg(F.avg("label")).first()[0]
    assert all(abs(r.pred - mean) < 1e-9 for r in flat.predict(df.withColumns({c: F.lit(1.0) for c in XS}), keep=[]).collect())
    one, _ = linear.fit_folds(df.limit(1), XS, None)
    assert abs(one.predict(df.limit(1), keep=["label"]).select(F.col("pred") - F.col("label")).first()[0]) < 1e-9
    with pytest.raises(ValueError, match="no rows"):
        linear.fit_folds(df.where("false"), XS)
    for bad in (None, float("inf"), float("nan")):
        with pytest.raises(ValueError, match="x2"):
            linear.fit_folds(df.withColumn("x2", F.when(F.col("RestaurantID") == 3, F.lit(bad)).otherwise(F.col("x2"))), XS)
