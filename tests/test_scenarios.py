import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from tests.helpers import SF_SMALL
from outletlens.operators import optimize as O
from outletlens.operators import scenarios as S
from outletlens.schema import DEFAULT_SCENARIO, SCENARIO
from outletlens.plans.catalog import base_table


def scen_frame(spark, rows):
    full = []
    for i, r in enumerate(rows):
        d = dict(scenario_id=i, name=f"s{i}", user="u", cuisine="Asian", segment="Casual", subregion="ASIA",
                 saved_at=dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), **DEFAULT_SCENARIO)
        d.update(r)
        full.append(tuple(d[f.name] for f in SCENARIO.fields))
    return spark.createDataFrame(full, SCENARIO)


def test_default_scenario_trips_share_warning(spark):
    r = S.share_check(scen_frame(spark, [{}])).first()
    assert abs(r.share_total - 1.24) < 1e-12 and r.share_warning


def test_risk_rules(spark):
    df = spark.createDataFrame([(-10.0, 10.0, 5.0), (90.0, 130.0, 100.0), (95.0, 105.0, 100.0), (0.0, 90.0, 100.0)],
                               "l double, u double, p double")
    got = [r.risk for r in df.select(*S.risk_label("l", "u", "p")).collect()]
    assert got == ["High", "Medium", "Low", "High"]


def test_channel_breakdown_by_hand(spark):
    b = {r.Channel: r for r in S.channel_breakdown(scen_frame(spark, [{}])).collect()}
    d = DEFAULT_SCENARIO
    rev = d["aov"] * d["orders"]
    keep = 1 - d["cogs"] - d["opex"]
    assert abs(b["In-Store"].NetProfit - rev * d["in_store"] * keep) < 1e-9
    assert abs(b["Uber Eats"].NetProfit - rev * d["ue_share"] * (keep - d["commission"])) < 1e-9
    sd = rev * d["sd_share"] * keep - d["delivery_cost"] * d["orders"] * d["sd_share"]
    assert abs(b["Self-Delivery"].NetProfit - sd) < 1e-9


def test_sweep_is_linspace(spark):
    got = [r.commission for r in S.commission_sweep(scen_frame(spark, [{}])).orderBy("sweep_idx").collect()]
    assert np.allclose(got, np.linspace(0.27, 0.33, 30), rtol=0, atol=1e-15) and got[-1] == 0.33


def test_scenario_features_flag_unknown_category(spark):
    bt = base_table(spark, SF_SMALL)
    f = S.scenario_features(scen_frame(spark, [{}, {"cuisine": "Martian"}]), bt).orderBy("scenario_id").collect()
    assert f[0].feature_error is None and f[0].CuisineType_enc == 0
    assert f[1].feature_error == "unknown cuisine"


def test_saved_comparison_keeps_latest_five(spark):
    rows = [{"user": "a"} for _ in range(7)] + [{"user": "b"}]
    out = S.saved_comparison(S.unit_economics_profit(scen_frame(spark, rows))).collect()
    a = sorted(r.scenario_id for r in out if r.user == "a")
    assert a == [2, 3, 4, 5, 6]
    assert all(r.comparable for r in out if r.user == "a")
    assert not [r for r in out if r.user == "b"][0].comparable


def test_grid_optimum_beats_feasible_baseline(spark):
    bt = base_table(spark, SF_SMALL)
    scen = scen_frame(spark, [{}, {"commission": 0.33, "delivery_cost": 5.0}])
    res = O.optimise_unit_economics(scen, bt, step_pct=5).collect()
    for r in res:
        assert r.feasible
        assert abs(r.opt_in_store + r.opt_ue_share + r.opt_dd_share + r.opt_sd_share - 1.0) < 1e-12
    # brute force over the same grid
    b = O.bounds_row(bt, 5).first()
    cands = [(a, bb, c, 100 - a - bb - c) for a in range(0, 101, 5) for bb in range(0, 101, 5)
             for c in range(0, 101, 5) if 100 - a - bb - c >= 0]
    ok = [m for m in cands if all(getattr(b, f"ilo_{s}") <= v <= getattr(b, f"ihi_{s}")
                                  for s, v in zip(O.SHARES, m))]
    d = DEFAULT_SCENARIO
    keep = 1 - d["cogs"] - d["opex"]
    rev = d["aov"] * d["orders"]
    best = max(ok, key=lambda m: (rev * m[0] / 100 * keep + rev * m[1] / 100 * (keep - d["commission"])
                                  + rev * m[2] / 100 * (keep - d["commission"])
                                  + rev * m[3] / 100 * keep - d["delivery_cost"] * d["orders"] * m[3] / 100, -m[0]))
    r0 = [r for r in res if r.scenario_id == 0][0]
    assert (round(r0.opt_in_store * 100), round(r0.opt_ue_share * 100)) == (best[0], best[1])
    assert F is not None


def test_export_summary_keeps_a_scenario_that_could_not_be_scored(spark):
    scen = scen_frame(spark, [{}, {"cuisine": "unknown"}])
    scored = spark.createDataFrame([(0, "A", True, 12.345, "Low"), (0, "B", False, 1.0, "High"), (1, "A", True, None, None), (1, "B", False, None, None)],
                                   "scenario_id long, model string, is_best boolean, pred double, risk string")
    rows = S.export_summary(scen, scored, "A").collect()
    of = lambda i: {(r.Section, r.Metric): r.Value for r in rows if r.scenario_id == i}
    assert len(rows) == 2 * (15 + 2 + 2)
    assert of(0)[("Model Forecasts", "A")] in ("12.34", "12.35") and of(0)[("Scenario Inputs", "Best-Model Risk")] == "Low"
    assert of(0)[("Scenario Inputs", "Best Model")] == "A" and of(0)[("Scenario Inputs", "Monthly Orders")] == "1190"
    assert of(1)[("Model Forecasts", "B")] is None and of(1)[("Scenario Inputs", "Cuisine Type")] == "unknown"


def test_sweep_predictions_have_every_point_and_an_optional_band(spark):
    class Commission:
        def predict(self, df, keep):
            return df.select(*keep, (F.col("CommissionRate") * 1000).alias("pred"))
    codes = {c: spark.createDataFrame([(v, 0)], f"{c} string, {c}_enc int") for c, v in
             [("CuisineType", "Asian"), ("Segment", "Casual"), ("Subregion", "ASIA")]}
    scen = scen_frame(spark, [{}, {"segment": "unknown"}])
    band = lambda x: x.withColumns({"band_lower": F.col("pred") - 1, "band_upper": F.col("pred") + 1})
    rows = S.sweep_predictions(scen, Commission(), band, codes=codes).orderBy("sweep_idx").collect()
    assert [r.sweep_idx for r in rows] == list(range(30)) and {r.scenario_id for r in rows} == {0}
    assert (rows[0].pred, rows[-1].pred, rows[0].commission_pct, rows[-1].p97_5) == (270.0, 330.0, 27.0, 331.0)
    assert "p2_5" not in S.sweep_predictions(scen, Commission(), codes=codes).columns
