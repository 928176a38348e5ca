import numpy as np
from pyspark.sql import functions as F

from outletlens.ml.evaluate import coverage, regression_metrics
from outletlens.ml.importance import permutation_importance, with_donors
from outletlens.ml.models import fit_model
from outletlens.ml.quantile import fit_quantile_booster
from outletlens.ml.store import bundle_complete, load_bundle, save_bundle


def planted(spark, n=400, seed=0):
    rng = np.random.default_rng(seed)
    x1, x2, x3 = rng.normal(size=(3, n))
    y = 3 * x1 - 2 * x2 + 5
    rows = [(int(i), 1998, 1, float(a), float(b), float(c), float(t)) for i, (a, b, c, t) in enumerate(zip(x1, x2, x3, y))]
    return spark.createDataFrame(rows, "RestaurantID long, Yr int, Mo int, x1 double, x2 double, x3 double, label double")


def test_linear_regression_recovers_plant_and_unused_feature_has_no_importance(spark):
    df = planted(spark)
    m = fit_model("Linear Regression", df, ["x1", "x2", "x3"])
    lr = m.pipeline.stages[-1]
    scales = [m.scaler.scales[f] for f in ["x1", "x2", "x3"]]
    coef = [c / s for c, s in zip(lr.coefficients, scales)]
    assert np.allclose(coef, [3, -2, 0], atol=1e-6)
    p = m.predict(df, keep=["label"]).withColumn("model", F.lit("lr"))
    assert regression_metrics(p).first().R2 > 0.999999
    imp = {r.feature: r.importance_mean for r in permutation_importance(m, df, ["x1", "x2", "x3"], n_repeats=3).collect()}
    assert abs(imp["x3"]) < 1e-9 and imp["x1"] > imp["x2"] > 0.5


def test_permutation_is_the_same_cycle_at_any_size(spark):
    df = planted(spark)
    m = fit_model("Linear Regression", df, ["x1", "x2", "x3"])
    one, many = ({r.feature: (r.importance_mean, r.importance_std) for r in permutation_importance(m, df, n_repeats=3, bucket_rows=b).collect()}
                 for b in (100_000, 7))
    assert all(np.allclose(one[f], many[f], rtol=0, atol=1e-9) for f in one) and len(one) == 3


def test_donors_of_a_repeat_are_one_cycle_over_all_rows(spark):
    df = planted(spark, 60).withColumn("id", F.col("RestaurantID").cast("double"))
    seen = []
    for slices in (1, 5, 500):       # 500: most slices have no row
        rows = with_donors(df, ["id"], 3, slices=slices).select("RestaurantID", "repeat", F.get("_donor", F.lit(0)).alias("d")).collect()
        seen.append(sorted(rows))
        for r in range(3):
            donor = {x.RestaurantID: int(x.d) for x in rows if x.repeat == r}
            at, steps = 0, 0
            while steps == 0 or at != 0:
                at, steps = donor[at], steps + 1
            assert len(donor) == steps == 60
    assert seen[0] == seen[1] == seen[2]
    one = with_donors(df.where("id = 7"), ["id"], 2).collect()
    assert [r._donor for r in one] == [[7.0], [7.0]]
    assert with_donors(df.where("false"), ["id"], 2).count() == 0


def test_rows_are_shuffled_once_a_repeat_and_fanned_out_after(spark):
    df = planted(spark, 60)
    plan = with_donors(df, ["x1", "x2", "x3"], 3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("explode") == 2 and "posexplode" not in plan       # rows and slices' first rows, by repeat only


def test_quantile_booster_orders_bands(spark):
    rng = np.random.default_rng(5)
    x = rng.uniform(0, 10, 600)
    y = x + x * rng.uniform(-1, 1, 600)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, label double")
    lo = fit_quantile_booster(df, 0.1, rounds=4, features=["x"])
    hi = fit_quantile_booster(df, 0.9, rounds=4, features=["x"])
    p = hi.predict(lo.predict(df, "lower"), "upper").withColumn("model", F.lit("q"))
    c = coverage(p, lower="lower", upper="upper", median="lower").first()
    assert 55 <= c.coverage_pct <= 100 and c.mean_width > 0


def test_bundle_round_trip(spark, tmp_path):
    df = planted(spark, 100)
    m = fit_model("Linear Regression", df, ["x1", "x2", "x3"])
    metrics = spark.createDataFrame([("Linear Regression",) + (1.0,) * 8],
                                    "model string, CV_RMSE_mean double, CV_RMSE_std double, CV_R2_mean double, "
                                    "CV_R2_std double, CV_MAE_mean double, CV_MAE_std double, residual_low double, "
                                    "residual_high double")
    save_bundle(spark, str(tmp_path / "b"), {"Linear Regression": m}, metrics)
    fitted, back = load_bundle(spark, str(tmp_path / "b"))
    assert bundle_complete(back)
    a = m.predict(df, keep=["RestaurantID"]).orderBy("RestaurantID").collect()
    b = fitted["Linear Regression"].predict(df, keep=["RestaurantID"]).orderBy("RestaurantID").collect()
    assert [r.pred for r in a] == [r.pred for r in b]
    assert load_bundle(spark, str(tmp_path / "missing")) is None
    assert not bundle_complete(metrics.withColumn("residual_low", F.lit(None).cast("double")))


def test_score_scenarios_interval_choice(spark):
    from outletlens.operators.scenarios import score_scenarios
    df = planted(spark, 120)
    m = fit_model("Linear Regression", df, ["x1", "x2", "x3"])
    m2 = fit_model("Random Forest", df, ["x1", "x2", "x3"], n_trees=3, rf_depth=3)
    feats = df.withColumnRenamed("RestaurantID", "scenario_id")
    metrics = spark.createDataFrame([("Linear Regression", -1.0, 2.0), ("Random Forest", -5.0, 5.0)],
                                    "model string, residual_low double, residual_high double")
    band = feats.select("scenario_id", F.lit(-100.0).alias("band_lower"), F.lit(100.0).alias("band_upper"))
    out = score_scenarios(feats, {"Linear Regression": m, "Random Forest": m2}, metrics,
                          "Random Forest", band).collect()
    for r in out:
        if r.model == "Random Forest":
            assert r.is_best and (r.lower, r.upper) == (-100.0, 100.0) and r.risk == "High"
        else:
            assert not r.is_best and abs(r.lower - (r.pred - 1.0)) < 1e-12 and abs(r.upper - (r.pred + 2.0)) < 1e-12
    assert len(out) == 240


def test_registered_regularised_boosting_runs_all_rounds(monkeypatch):
    from outletlens.plans.catalog import QUERIES, q_ml
    seen = {}
    monkeypatch.setattr(q_ml, "prepared_table", lambda spark, sf_dir: None)
    monkeypatch.setattr(q_ml, "train_and_evaluate", lambda prep, **how: seen.update(how) or (None, None, "metrics"))
    assert QUERIES["m8_regularised_boosting"](None, "") == "metrics" and seen["rounds"] == 100
