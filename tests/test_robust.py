"""Values a fixture never has: zero means, empty sides, infinities, unseen categories, ties."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from outletlens.functions.binning import assign_bins
from outletlens.functions.quantiles import exact_quantiles
from outletlens.ml.prepare import check_finite, encode_categories, usable_features
from outletlens.ml.relational import fit_group_mean
from outletlens.operators import aggregates as A
from outletlens.operators import distributions as D
from outletlens.operators import optimize as O
from outletlens.operators import ranking
from outletlens.operators import scenarios as S
from outletlens.operators.features import prepare
from outletlens.schema import DEFAULT_SCENARIO
from tests.helpers import frame, outlet_row

INF = float("inf")


def test_pivot_keeps_unseen_segments(spark):
    t = prepare(frame(spark, [outlet_row(RestaurantID=1), outlet_row(RestaurantID=2, Segment="QSR")]))
    assert set(A.cuisine_segment_pivot(t).columns) == {"CuisineType", "Casual", "QSR"}


def test_divisions_by_zero(spark):
    zero = {c: 0.0 for c in ("InStoreNetProfit", "UberEatsNetProfit", "DoorDashNetProfit", "SelfDeliveryNetProfit", "InStoreRevenue",
                             "UberEatsRevenue", "DoorDashRevenue", "SelfDeliveryRevenue", "InStoreShare", "UE_share", "DD_share", "SD_share")}
    t = prepare(frame(spark, [outlet_row(RestaurantID=i, CommissionRate=0.27, GrowthFactor=0.0, **zero) for i in (1, 2)]))
    k = A.optimisation_kpis(t).first()
    assert k.sensitivity_index is None and k.uplift_pct is None
    impact = A.commission_impact(t).first()                  # nobody pays more than 30 %
    assert impact.high_comm_profit is None and impact.impact_pct is None
    assert [r.mean_normalised for r in A.share_bounds(t).collect()] == [None] * 4
    assert ranking.optimisation_score(t).count() == 2


def test_violin_of_a_single_row_and_of_equal_rows(spark):
    df = spark.createDataFrame([("one", 5.0)] + [("equal", 2.0)] * 4 + [("many", float(i)) for i in range(20)] + [("many", INF)], "g string, v double")
    out = D.violin_density(df, "v", "g", grid=5).collect()
    assert all((r.density is None) == (r.g != "many") for r in out) and len(out) == 15


def test_bins_of_infinite_values(spark):
    xs = [1.0, 2.0, 3.0, 4.0, 5.0, INF, -INF, float("nan"), None]
    b = assign_bins(spark.createDataFrame([(x,) for x in xs], "v double"), "v", 4, "bin").collect()
    assert [r.bin for r in b] == [1, 1, 2, 3, 4, None, None, None, None]
    assert all(r.bin_lo < r.v <= r.bin_hi for r in b[:5])


@pytest.mark.parametrize("seed", range(3))
def test_bins_equal_pandas_cut(spark, seed):
    pd = pytest.importorskip("pandas")
    r = np.random.default_rng(seed)
    xs = np.concatenate((r.normal(0, 1e6, 300), np.linspace(-3, 7, 101), r.integers(-5, 5, 100).astype(float)))
    got = assign_bins(spark.createDataFrame([(float(x),) for x in xs], "v double").coalesce(1), "v", 50, "bin").select("bin").collect()
    assert [x.bin for x in got] == (pd.cut(xs, bins=50, labels=False) + 1).tolist()


def test_quantiles_with_infinities_and_refinement(spark):
    r = np.random.default_rng(1)
    xs = np.concatenate((r.normal(size=3000), [INF] * 20, [-INF] * 30, [7.0] * 500, [1e300, -1e300]))
    df = spark.createDataFrame([(float(x), i % 2) for i, x in enumerate(xs)], "v double, g int").repartition(4)
    probs = {"a": 0.001, "b": 0.25, "c": 0.5, "d": 0.9, "e": 0.999}
    for kw in ({}, {"by": ["g"]}, {"by": ["g"], "bounded_groups": True}):
        for row in exact_quantiles(df, "v", probs, bins=8, refine_rows=10, **kw).collect():
            mine = xs if not kw else xs[np.arange(len(xs)) % 2 == row.g]
            for k, p in probs.items():
                s = np.sort(mine)
                h = (len(s) - 1) * p
                lo, hi = s[math.floor(h)], s[min(math.floor(h) + 1, len(s) - 1)]
                want = lo if lo == hi else lo + (hi - lo) * (h - math.floor(h))
                assert row[k] == want or math.isclose(row[k], want, rel_tol=1e-12)


def test_correlation_pairwise_complete(spark):
    pd = pytest.importorskip("pandas")
    r = np.random.default_rng(0)
    x = r.normal(size=(200, 4))
    x[:, 3] = 5.0
    x[r.random(x.shape) < 0.2] = np.nan
    x[:, 1] = np.where(np.isnan(x[:, 1]), np.nan, x[:, 1] * 1e6 + x[:, 0].clip(-1) * 1e5)
    cols = list("abcd")
    df = spark.createDataFrame([tuple(None if np.isnan(v) and i % 2 else float(v) for v in row) for i, row in enumerate(x)], "a double, b double, c double, d double")
    want = pd.DataFrame(x, columns=cols)
    for row in A.correlation_matrix(df, cols).collect():
        w = want[row.x].corr(want[row.y])
        assert (row.r is None) if np.isnan(w) else math.isclose(row.r, w, rel_tol=1e-9, abs_tol=1e-9)
    assert all(row.r is None for row in A.correlation_matrix(df.limit(0), cols).collect())


def test_top_k_without_month_columns(spark):
    t = prepare(frame(spark, [outlet_row(RestaurantID=i) for i in range(3)])).drop("Yr", "Mo")
    assert [r.RestaurantID for r in ranking.top_profit(t, 2, key_cols=["RestaurantID"]).collect()] == [0, 1]
    assert ranking.top_score(t, 2, key_cols=["RestaurantID"]).count() == 2


def _scenarios(spark, rows):
    base = dict(DEFAULT_SCENARIO, cuisine="Asian", segment="Casual", subregion="ASIA")
    rows = [dict(base, scenario_id=i, **r) for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r[k] for k in sorted(r)) for r in rows], sorted(rows[0]))


def test_unknown_category_does_not_fail_the_batch(spark):
    t = prepare(frame(spark, [outlet_row(RestaurantID=i) for i in range(3)]))
    feats = S.scenario_features(_scenarios(spark, [{}, {"segment": "Unheard of"}]), t)
    train = encode_categories(t).select(F.col("Segment_enc").cast("double").alias("Segment_enc"), F.col("TotalNetProfit").alias("label"))
    model = fit_group_mean("m", train, "Segment_enc")
    metrics = spark.createDataFrame([("m", -1.0, 1.0)], "model string, residual_low double, residual_high double")
    out = {r.scenario_id: r for r in S.score_scenarios(feats, {"m": model}, metrics, "m").collect()}
    assert out[0].pred is not None and out[0].risk is not None
    assert out[1].pred is None and out[1].risk is None and out[1].lower is None


def test_greedy_mix_equals_brute_force(spark):
    r = np.random.default_rng(4)
    rows = [dict(commission=float(c), delivery_cost=float(d), cogs=float(g)) for c, d, g in
            zip(r.uniform(0, 0.4, 12), r.uniform(0, 30, 12), r.uniform(0.1, 0.9, 12))] + [dict(commission=0.0, delivery_cost=0.0)]
    scen = _scenarios(spark, rows)
    limits = dict(ilo_in_store=10, ihi_in_store=50, ilo_ue_share=5, ihi_ue_share=60, ilo_dd_share=0, ihi_dd_share=35, ilo_sd_share=5, ihi_sd_share=25)
    bounds = spark.createDataFrame([tuple(limits.values())], list(limits))
    mixes = [m for m in itertools.product(range(10, 51, 5), range(5, 61, 5), range(0, 36, 5), range(5, 26, 5)) if sum(m) == 100]
    for row in O.greedy_mix(scen, bounds).collect():
        x = dict(DEFAULT_SCENARIO, **rows[row.scenario_id])
        rev, keep = x["aov"] * x["orders"], 1 - x["cogs"] - x["opex"]
        w = (rev * keep, rev * (keep - x["commission"]), rev * (keep - x["commission"]), rev * keep - x["delivery_cost"] * x["orders"])
        best = min(mixes, key=lambda m: (-round(sum(a * b for a, b in zip(w, m, strict=True)), 6), m))
        assert tuple(round(100 * row[f"opt_{s}"]) for s in O.SHARES) == best
    none = spark.createDataFrame([tuple({**limits, "ihi_in_store": 12, "ihi_ue_share": 10}.values())], list(limits))
    assert all(x.opt_in_store is None for x in O.greedy_mix(scen, none).collect())


def test_category_joins_do_not_shuffle_the_rows(spark):
    t = frame(spark, [outlet_row(RestaurantID=i, Segment=f"s{i % 4}") for i in range(40)])
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" not in encode_categories(t)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_infinite_training_rows_are_named(spark):
    df = spark.createDataFrame([(1.0, 2.0), (INF, 3.0)], "AOV double, label double")
    with pytest.raises(ValueError, match="AOV"):
        check_finite(df, ["AOV"])
    assert "ProfitPerOrder" not in usable_features(exclude_leaky=True) and "AOV" in usable_features(exclude_leaky=True)


def test_malformed_rows_are_a_data_error(spark, tmp_path):
    from outletlens.sources.io import OutletDataError, read_outlets, write_csv
    path = str(tmp_path / "outlets.csv")
    write_csv(frame(spark, [outlet_row(RestaurantID=i) for i in range(3)]), path, single_file=True)
    assert read_outlets(spark, path, validate=True).count() == 3
    part = next((tmp_path / "outlets.csv").glob("part-*.csv"))
    rows = part.read_text().splitlines()
    (tmp_path / "broken.csv").write_text("\n".join([*rows, rows[-1].replace(",100,", ",not a number,", 1)]) + "\n")
    with pytest.raises(OutletDataError):
        read_outlets(spark, str(tmp_path / "broken.csv"), validate=True)
