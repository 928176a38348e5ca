"""Cells against a scan of every mix, the exact optimum and its statuses."""

import pytest
from pyspark.sql import functions as F

from outletlens.ml.models import fit_model
from outletlens.operators import optimize as O
from outletlens.operators import scenarios as S
from outletlens.plans.catalog import base_table, code_tables, prepared_table
from tests.helpers import SF_SMALL, frame, outlet_row
from tests.test_scenarios import scen_frame


@pytest.fixture(scope="module")
def scen(spark):
    rows = [{}, {"commission": 0.33, "delivery_cost": 5.0, "aov": 30.0}, {"commission": 0.0, "orders": 0}, {"cuisine": "Martian"}]
    return S.attach_codes(scen_frame(spark, rows), codes=code_tables(spark, SF_SMALL))


@pytest.mark.parametrize("name,params", [("Random Forest", {"n_trees": 4, "rf_depth": 6}), ("Gradient Boosting", {"rounds": 4}), ("Linear Regression", {})])
def test_cells_find_what_a_full_scan_finds(spark, scen, name, params):
    outlets = base_table(spark, SF_SMALL)
    model = fit_model(name, prepared_table(spark, SF_SMALL).where("NOT is_test"), **params)
    step = 5 if name == "Linear Regression" else 1
    got = {r.scenario_id: r for r in O.optimise_with_model(scen, outlets, model, S.feature_columns, step).collect()}
    assert got[3].status == "unknown cuisine" and got[3].opt_objective is None and not got[3].feasible
    ok, _ = S.split_errors(scen)
    bounds = O.bounds_row(outlets, step)
    every = O.candidate_mixes(ok, bounds, step)
    scored = model.predict(S.feature_columns(every), keep=["scenario_id", "_a", "_b", "_c"]).toPandas()
    reps = O.cell_representatives(O.model_candidates(ok, bounds, model.thresholds(), step), S.feature_columns, model.thresholds())
    if model.thresholds():
        assert reps.count() < every.count() / 3
    for sid, part in scored.groupby("scenario_id"):
        top = part[part.pred == part.pred.max()].sort_values(["_a", "_b", "_c"]).iloc[0]
        r = got[sid]
        if r.baseline_objective > top.pred and r.baseline_in_range:
            assert r.opt_objective == r.baseline_objective and r.opt_in_store == r.baseline_in_store
        else:
            assert r.opt_objective == pytest.approx(top.pred, abs=1e-9)
            assert [round(100 * v) for v in (r.opt_in_store, r.opt_ue_share, r.opt_dd_share)] == [top._a, top._b, top._c]
        assert r.uplift >= 0 or not r.baseline_in_range


def test_band_at_the_optimum(spark, scen):
    outlets = base_table(spark, SF_SMALL)
    model = fit_model("Gradient Boosting", prepared_table(spark, SF_SMALL).where("NOT is_test"), rounds=2)
    band = lambda feats: feats.select("scenario_id", (F.col("InStoreShare") - 1).alias("band_lower"), (F.col("InStoreShare") + 1).alias("band_upper"))
    rows = O.optimise_with_model(scen, outlets, model, S.feature_columns, band=band).collect()
    assert all(r.band_lower == r.opt_in_store - 1 and r.band_upper == r.opt_in_store + 1 for r in rows if r.feasible)
    assert [r.band_lower for r in rows if not r.feasible] == [None]


def shares_of(spark, *values):
    return frame(spark, [outlet_row(RestaurantID=i, InStoreShare=v, UE_share=v, DD_share=v, SD_share=v) for i, v in enumerate(values)])


def test_exact_optimum_and_status(spark):
    scen = scen_frame(spark, [{}, {"aov": None}])
    status = lambda *values: {r.scenario_id: r for r in O.optimise_exact(scen, shares_of(spark, *values)).collect()}
    low, high, good = status(0.1, 0.1, 0.1), status(0.4, 0.4, 0.4), status(*[k / 100 for k in range(0, 101, 10)])
    assert low[0].status == "upper bounds add up to less than 100 %" and low[0].opt_objective is None
    assert high[0].status == "lower bounds add up to more than 100 %" and high[0].uplift is None
    assert good[1].status == "missing input"
    # bounds are 0.1 and 0.9 everywhere: in-store earns most, so it takes what the others leave
    r = good[0]
    assert [round(v, 9) for v in (r.opt_in_store, r.opt_ue_share, r.opt_dd_share, r.opt_sd_share)] == [0.7, 0.1, 0.1, 0.1]
    assert r.baseline_in_range and r.uplift > 0
    table = O.mix_report(O.optimise_exact(scen.where("scenario_id = 0"), shares_of(spark, *[k / 100 for k in range(0, 101, 10)])), shares_of(
        spark, *[k / 100 for k in range(0, 101, 10)])).orderBy("channel_order").collect()
    assert [t.safe_range for t in table] == ["10% to 90%"] * 4 and table[0].Optimized == pytest.approx(0.7)


def test_boxes_hold_the_first_mix_of_every_cell(spark, scen):
    """Split points on each share's own features alone: as many candidates as boxes, and every cell's first mix among them."""
    outlets = base_table(spark, SF_SMALL)
    points = {"InStoreShare": [0.15, 0.3], "UE_RevRatio": [0.2, 0.355], "Commission_UE": [0.05], "DD_share": [0.08, 0.3], "DeliveryCost_SD": [0.5, 1.0]}
    ok, _ = S.split_errors(scen)
    bounds = O.bounds_row(outlets)
    every, few = O.candidate_mixes(ok, bounds), O.model_candidates(ok, bounds, points)
    firsts = lambda c: sorted(map(tuple, O.cell_representatives(c, S.feature_columns, points).collect()))
    assert firsts(few) == firsts(every)
    assert 0 < few.count() <= ok.count() * 3 * 4 * 3 * 3 and few.count() < every.count() / 20
