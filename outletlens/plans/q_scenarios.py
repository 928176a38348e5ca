"""Registered scenario queries (W1-W11, X2-X5) with DuckDB twins where the
result does not depend on a fitted model."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.compat import round_even
from ..functions.quantiles import exact_quantiles
from ..ml.quantile import predict_band
from ..operators import aggregates as A
from ..operators import optimize as O
from ..operators import scenarios as S
from ..operators.ranking import best_model, latest_per_group
from ..schema import CATEGORY_COLS, CHANNELS, FEATURES, KEEP_SAVED_SCENARIOS, TARGET_COGS, TARGET_COST_TO_REVENUE, TARGET_OPEX
from ..sources.fixture import scenarios_from_outlets
from ..session import broadcast_if_small
from .catalog import base_table, code_tables, prepared_table, register, report
from ..ml.relational import GROUP_MODELS, fit_bin_mean
from .q_ml import _GM_CTES, _PREP_CTES, _codes, _group_models, _quantile_models, _trained
from .sqlbase import R6, RN, with_base

SC = ["in_store", "ue_share", "dd_share", "sd_share"]


def _bt(spark, sf_dir):
    return base_table(spark, sf_dir)


def _scen(spark, sf_dir):
    bt = _bt(spark, sf_dir)
    return bt, scenarios_from_outlets(bt)


_SCEN_CTE = ("scen AS (SELECT CAST(RestaurantID * 1000000 + Yr * 100 + Mo AS BIGINT) AS scenario_id, "
             "RestaurantID AS _rid, Yr AS _yr, Mo AS _mo, RestaurantName AS name, Subregion AS \"user\", "
             "InStoreShare AS in_store, UE_share AS ue_share, DD_share AS dd_share, SD_share AS sd_share, "
             "CommissionRate AS commission, DeliveryCostPerOrder AS delivery_cost, DeliveryRadiusKM AS radius, "
             "GrowthFactor AS growth, AOV AS aov, MonthlyOrders AS orders, COGSRate AS cogs, OPEXRate AS opex, "
             "CuisineType AS cuisine, Segment AS segment, Subregion AS subregion FROM t)")

_REV = "(aov * orders)"
_W1_COLS = {
    "InStoreShare": "in_store", "UE_share": "ue_share", "DD_share": "dd_share", "SD_share": "sd_share",
    "CommissionRate": "commission", "DeliveryCostPerOrder": "delivery_cost",
    "DeliveryRadiusKM": "CAST(radius AS DOUBLE)", "GrowthFactor": "growth", "AOV": "aov",
    "MonthlyOrders": "CAST(orders AS DOUBLE)", "COGSRate": "cogs", "OPEXRate": "opex",
    "Commission_UE": "commission * ue_share", "DeliveryCost_SD": "delivery_cost * sd_share",
    "GrowthAdj_Orders": "orders * growth", "CostToRevenue": "cogs + opex",
    **{r: f"CASE WHEN {_REV} <> 0 THEN ({_REV} * {s}) / {_REV} ELSE 0e0 END"
       for r, s in zip(["InStoreRevRatio", "UE_RevRatio", "DD_RevRatio", "SD_RevRatio"], SC)},
    "RevenuePerOrder": "aov",
    "ProfitPerOrder": (f"CASE WHEN orders <> 0 THEN ({_REV} * (1e0 - cogs - opex) - {_REV} * ue_share * commission "
                       f"- {_REV} * dd_share * commission - delivery_cost * orders * sd_share) / orders ELSE 0e0 END"),
}
_UE_PROFIT = (f"({_REV} * in_store * (1e0 - cogs - opex) + {_REV} * ue_share * ((1e0 - cogs - opex) - commission) "
              f"+ {_REV} * dd_share * ((1e0 - cogs - opex) - commission) "
              f"+ ({_REV} * sd_share * (1e0 - cogs - opex) - delivery_cost * (orders * sd_share)))")


# --- W1 ----------------------------------------------------------------------------
@register("w1_scenario_features", sql=with_base(
    "SELECT scenario_id, " + ", ".join(f"{R6(e)} AS {f}" for f, e in _W1_COLS.items()) + ", "
    + ", ".join(f"c_{c}.{c}_enc" for c in CATEGORY_COLS)
    + ", COALESCE(CASE WHEN c_CuisineType.CuisineType_enc IS NULL THEN 'unknown cuisine' END, "
    "CASE WHEN c_Segment.Segment_enc IS NULL THEN 'unknown segment' END, "
    "CASE WHEN c_Subregion.Subregion_enc IS NULL THEN 'unknown subregion' END) AS feature_error FROM scen "
    "LEFT JOIN c_CuisineType ON c_CuisineType.CuisineType = scen.cuisine "
    "LEFT JOIN c_Segment ON c_Segment.Segment = scen.segment "
    "LEFT JOIN c_Subregion ON c_Subregion.Subregion = scen.subregion", _SCEN_CTE, *_codes("t")))
def w1_scenario_features(spark, sf_dir):
    bt, scen = _scen(spark, sf_dir)
    f = S.scenario_features(scen, codes=code_tables(spark, sf_dir))
    return report(f.select("scenario_id", *FEATURES, "feature_error"))


# --- W2 ----------------------------------------------------------------------------
@register("w2_share_check", sql=with_base(
    f"SELECT scenario_id, {R6('in_store + ue_share + dd_share + sd_share')} AS share_total, "
    "abs(in_store + ue_share + dd_share + sd_share - 1e0) > 0.15e0 AS share_warning FROM scen", _SCEN_CTE))
def w2_share_check(spark, sf_dir):
    _, scen = _scen(spark, sf_dir)
    return report(S.share_check(scen).select("scenario_id", "share_total", "share_warning"))


# --- W5 on a relational band -----------------------------------------------------
_W5_CTES = [_SCEN_CTE,
            "sd AS (SELECT Segment, quantile_cont(TotalNetProfit, 0.25) AS q1, quantile_cont(TotalNetProfit, 0.5) AS q2, "
            "quantile_cont(TotalNetProfit, 0.75) AS q3 FROM t WHERE Segment IS NOT NULL GROUP BY Segment)",
            f"b AS (SELECT scenario_id, {_UE_PROFIT} AS pred, {_UE_PROFIT} + (sd.q1 - sd.q2) AS lower, "
            f"{_UE_PROFIT} + (sd.q3 - sd.q2) AS upper FROM scen LEFT JOIN sd ON sd.Segment = scen.segment)"]
_W5_WIDTH = "((upper - lower) / greatest(abs(pred), 1e0) * 100e0)"


@register("w5_risk_labels", sql=with_base(
    f"SELECT scenario_id, {RN('pred', 2)} AS pred, {RN('lower', 2)} AS lower, {RN('upper', 2)} AS upper, "
    f"CASE WHEN (lower < 0 AND upper > 0) OR {_W5_WIDTH} >= 80e0 THEN 'High' WHEN {_W5_WIDTH} >= 40e0 THEN 'Medium' "
    f"ELSE 'Low' END AS risk, {RN(_W5_WIDTH, 4)} AS width_pct FROM b", *_W5_CTES))
def w5_risk_labels(spark, sf_dir):
    """Risk of each scenario with the unit-economics profit as the point
    forecast and the segment's profit quartile spread around it as the band."""
    bt, scen = _scen(spark, sf_dir)
    q = exact_quantiles(bt.where(F.col("Segment").isNotNull()), "TotalNetProfit",
                        {"_q1": 0.25, "_q2": 0.5, "_q3": 0.75}, by=["Segment"])
    q = broadcast_if_small(q).withColumnRenamed("Segment", "_seg")      # one row per segment
    p = S.unit_economics_profit(scen).join(q, F.col("segment") == F.col("_seg"), "left")
    p = p.select("scenario_id", F.col("ue_profit").alias("pred"),
                 (F.col("ue_profit") + (F.col("_q1") - F.col("_q2"))).alias("lower"),
                 (F.col("ue_profit") + (F.col("_q3") - F.col("_q2"))).alias("upper"))
    out = p.select("scenario_id", "pred", "lower", "upper", *S.risk_label("lower", "upper", "pred"))
    # money at cents, width at 4 decimals (quartiles may differ in the last bit between engines)
    return out.withColumns({**{c: round_even(c, 2) for c in ("pred", "lower", "upper")},
                            "width_pct": round_even("width_pct", 4)})


# --- W6 ----------------------------------------------------------------------------
def _w6_body():
    parts = []
    for i, (ch, s) in enumerate(zip(CHANNELS, SC)):
        rev = f"(aov * orders * {s})"
        keep = "(1e0 - cogs - opex)"
        prof = (f"{rev} * ({keep} - commission)" if ch in ("Uber Eats", "DoorDash")
                else f"{rev} * {keep} - delivery_cost * (orders * {s})" if ch == "Self-Delivery" else f"{rev} * {keep}")
        parts.append(f"SELECT scenario_id, {i} AS channel_order, '{ch}' AS Channel, {R6(rev)} AS Revenue, "
                     f"{R6(prof)} AS NetProfit, {R6(f'CASE WHEN {rev} <> 0 THEN ({prof}) / {rev} ELSE 0e0 END')} AS Margin FROM scen")
    return " UNION ALL ".join(parts)


def _w6_sql():
    return with_base(_w6_body(), _SCEN_CTE)


@register("w6_channel_breakdown", sql=_w6_sql())
def w6_channel_breakdown(spark, sf_dir):
    _, scen = _scen(spark, sf_dir)
    return report(S.channel_breakdown(scen))


# --- W7 (features of the sweep; X5) ------------------------------------------------
_SWEEP = "(CASE WHEN i = 29 THEN 0.33e0 ELSE 0.27e0 + CAST(i AS DOUBLE) * ((0.33e0 - 0.27e0) / 29e0) END)"


@register("w7_commission_sweep", sql=with_base(
    f"SELECT scenario_id, CAST(i AS INT) AS sweep_idx, {R6('commission')} AS commission, "
    f"{R6(_W1_COLS['Commission_UE'])} AS Commission_UE, {R6(_W1_COLS['ProfitPerOrder'])} AS ProfitPerOrder, "
    f"{R6(_UE_PROFIT)} AS ue_profit FROM (SELECT scen.* EXCLUDE (commission), i, {_SWEEP} AS commission "
    "FROM scen, (SELECT unnest(range(0, 30)) AS i) r) s", _SCEN_CTE))
def w7_commission_sweep(spark, sf_dir):
    bt, scen = _scen(spark, sf_dir)
    sw = S.unit_economics_profit(S.feature_columns(S.commission_sweep(S.attach_codes(scen, codes=code_tables(spark, sf_dir)))))
    return report(sw.select("scenario_id", "sweep_idx", "commission", "Commission_UE", "ProfitPerOrder", "ue_profit"))


@register("w7_sweep_predictions")
def w7_sweep_predictions(spark, sf_dir):
    """Best model + quantile band at every sweep point of every scenario (X2: round 2)."""
    prep, fitted, _, metrics = _trained(spark, sf_dir)
    best = best_model(metrics).first()["model"]
    qm = _quantile_models(spark, sf_dir)
    return S.sweep_predictions(_scen(spark, sf_dir)[1], fitted[best], lambda x: predict_band(qm, x), codes=code_tables(spark, sf_dir))


# --- W3, W4, W5 with the fitted models ---------------------------------------------------
@register("w3_w4_scenario_forecasts")
def w3_w4_scenario_forecasts(spark, sf_dir):
    """Every model scores every scenario; the best model carries the quantile
    band, the others their empirical residual interval; risk per row."""
    prep, fitted, _, metrics = _trained(spark, sf_dir)
    best = best_model(metrics).first()["model"]
    bt, scen = _scen(spark, sf_dir)
    feats = S.scenario_features(scen, codes=code_tables(spark, sf_dir))
    band = predict_band(_quantile_models(spark, sf_dir), S.split_errors(feats)[0]).select("scenario_id", "band_lower", "band_upper")
    return S.score_scenarios(feats, fitted, metrics, best, band)


_GROUP_SCORES = [
    "sc AS (" + " UNION ALL ".join(
        f"SELECT scenario_id, '{n}' AS model, m.p AS pred FROM scen JOIN c_{c} ON c_{c}.{c} = scen.{s} "
        f"JOIN (SELECT {c}_enc AS g, avg(label) AS p FROM sp WHERE NOT is_test GROUP BY 1) m ON m.g = c_{c}.{c}_enc"
        for (n, _), c, s in zip(GROUP_MODELS, CATEGORY_COLS, ["cuisine", "segment", "subregion"])) + ")",
    "ri AS (SELECT scenario_id, sc.model, sc.model = (SELECT model FROM rt ORDER BY R2 DESC NULLS LAST, model_order LIMIT 1) AS is_best, "
    "pred, pred + residual_low AS lower, pred + residual_high AS upper FROM sc JOIN rt ON rt.model = sc.model)"]


@register("w3_w4_group_model_forecasts", sql=with_base(
    f"SELECT scenario_id, model, is_best, {RN('pred', 2)} AS pred, {RN('lower', 2)} AS lower, {RN('upper', 2)} AS upper, "
    f"CASE WHEN (lower < 0 AND upper > 0) OR {_W5_WIDTH} >= 80e0 THEN 'High' WHEN {_W5_WIDTH} >= 40e0 THEN 'Medium' "
    f"ELSE 'Low' END AS risk, {RN(_W5_WIDTH, 4)} AS width_pct FROM ri", *_GM_CTES, _SCEN_CTE, *_GROUP_SCORES))
def w3_w4_group_model_forecasts(spark, sf_dir):
    """Every relational model scores every scenario, with its empirical interval and risk."""
    fitted, _, metrics = _group_models(spark, sf_dir)
    best = best_model(metrics).first()["model"]
    _, scen = _scen(spark, sf_dir)
    out = S.score_scenarios(S.scenario_features(scen, codes=code_tables(spark, sf_dir)), fitted, metrics, best)
    return out.withColumns({**{c: round_even(c, 2) for c in ("pred", "lower", "upper")}, "width_pct": round_even("width_pct", 4)})


# --- W8 (exports: summary union, breakdown) -----------------------------------------------
@register("w8_export_summary")
def w8_export_summary(spark, sf_dir):
    """Inputs and model forecasts of every scenario as (Section, Metric, Value) text rows."""
    _, fitted, _, metrics = _trained(spark, sf_dir)
    best = best_model(metrics).first()["model"]
    bt, scen = _scen(spark, sf_dir)
    feats = S.scenario_features(scen, codes=code_tables(spark, sf_dir))
    band = predict_band(_quantile_models(spark, sf_dir), S.split_errors(feats)[0]).select("scenario_id", "band_lower", "band_upper")
    return S.export_summary(scen, S.score_scenarios(feats, fitted, metrics, best, band), best)


def _segment_band(spark, sf_dir, rows, segment):
    """``rows`` with the profit band of their segment (quantiles of the training labels) in place of fitted ones."""
    train = prepared_table(spark, sf_dir).where(~F.col("is_test"))
    q = exact_quantiles(train, "label", {"_lo": 0.025, "_up": 0.975}, by=["Segment"])
    q = broadcast_if_small(q).withColumnRenamed("Segment", "_seg")      # one row per segment
    return rows.join(q, F.col(segment) == F.col("_seg"), "left").withColumns(
        {"band_lower": F.least("_lo", "_up"), "band_upper": F.greatest("_lo", "_up")}).drop("_lo", "_up", "_seg")


def _banded_group_scores(spark, sf_dir):
    """(scenarios, best model, scores): the relational models, the best one with its segment's band."""
    fitted, _, metrics = _group_models(spark, sf_dir)
    best = best_model(metrics).first()["model"]
    _, scen = _scen(spark, sf_dir)
    band = _segment_band(spark, sf_dir, scen.select("scenario_id", "segment"), "segment")
    scored = S.score_scenarios(S.scenario_features(scen, codes=code_tables(spark, sf_dir)), fitted, metrics, best, band)
    return scen, best, scored


_BAND_CTES = [*_GROUP_SCORES,
    "sq AS (SELECT Segment AS seg, quantile_cont(label, 0.025) AS lo, quantile_cont(label, 0.975) AS up FROM sp WHERE NOT is_test GROUP BY 1)",
    "rb AS (SELECT ri.scenario_id, model, is_best, pred, CASE WHEN is_best THEN least(sq.lo, sq.up) ELSE lower END AS lower, "
    "CASE WHEN is_best THEN greatest(sq.lo, sq.up) ELSE upper END AS upper FROM ri JOIN scen ON scen.scenario_id = ri.scenario_id "
    "JOIN sq ON sq.seg = scen.segment)"]
_RISK = (f"CASE WHEN (lower < 0 AND upper > 0) OR {_W5_WIDTH} >= 80e0 THEN 'High' WHEN {_W5_WIDTH} >= 40e0 THEN 'Medium' ELSE 'Low' END")


@register("w4_group_model_band_forecasts", sql=with_base(
    f"SELECT scenario_id, model, is_best, {RN('pred', 2)} AS pred, {RN('lower', 2)} AS lower, {RN('upper', 2)} AS upper, {_RISK} AS risk, "
    f"{RN(_W5_WIDTH, 4)} AS width_pct FROM rb", *_GM_CTES, _SCEN_CTE, *_BAND_CTES))
def w4_group_model_band_forecasts(spark, sf_dir):
    """Interval choice with a quantile band: the best model takes the band, the others their residual interval."""
    out = _banded_group_scores(spark, sf_dir)[2]
    return out.withColumns({**{c: round_even(c, 2) for c in ("pred", "lower", "upper")}, "width_pct": round_even("width_pct", 4)})


_BEST_SQL = "(SELECT model FROM rt ORDER BY R2 DESC NULLS LAST, model_order LIMIT 1)"


@register("w8_group_model_export_summary", sql=with_base(" UNION ALL ".join(
    [f"SELECT scenario_id, 'Scenario Inputs' AS Section, '{label}' AS Metric, CAST({c} AS VARCHAR) AS Value FROM scen" for label, c in S.EXPORT_INPUTS]
    + [f"SELECT scenario_id, 'Scenario Inputs', 'Best Model', {_BEST_SQL} FROM scen",
       f"SELECT scenario_id, 'Scenario Inputs', 'Best-Model Risk', {_RISK} FROM rb WHERE is_best",
       f"SELECT scenario_id, 'Model Forecasts', model, CAST({RN('pred', 2)} AS VARCHAR) FROM rb"]), *_GM_CTES, _SCEN_CTE, *_BAND_CTES))
def w8_group_model_export_summary(spark, sf_dir):
    """R4 with the relational models: inputs, best model, risk and forecasts as text rows."""
    scen, best, scored = _banded_group_scores(spark, sf_dir)
    return S.export_summary(scen, scored, best)


@register("w7_group_model_sweep_predictions", sql=with_base(
    f"SELECT rb.scenario_id, CAST(i AS INT) AS sweep_idx, {RN(_SWEEP + ' * 100e0', 2)} AS commission_pct, {RN('pred', 2)} AS pred, "
    f"{RN('lower', 2)} AS p2_5, {RN('upper', 2)} AS p97_5 FROM rb, (SELECT unnest(range(0, 30)) AS i) r WHERE is_best",
    *_GM_CTES, _SCEN_CTE, *_BAND_CTES))
def w7_group_model_sweep_predictions(spark, sf_dir):
    """The best relational model and its segment's band at every sweep point of every scenario."""
    fitted, _, metrics = _group_models(spark, sf_dir)
    best = best_model(metrics).first()["model"]
    return S.sweep_predictions(_scen(spark, sf_dir)[1], fitted[best], lambda x: _segment_band(spark, sf_dir, x, "segment"),
                               codes=code_tables(spark, sf_dir))


@register("w8_group_model_forecast_table", sql=with_base(
    f"SELECT scenario_id, ri.model AS Model, {RN('pred', 2)} AS predicted_net_profit, {RN('lower', 2)} AS p2_5, {RN('upper', 2)} AS p97_5, "
    f"{RN('rm', 2)} AS cv_rmse_mean, {RN('qm', 4)} AS cv_r2_mean, {RN('am', 2)} AS cv_mae_mean FROM ri JOIN cv ON cv.model = ri.model",
    *_GM_CTES, _SCEN_CTE, *_GROUP_SCORES))
def w8_group_model_forecast_table(spark, sf_dir):
    """The export's forecast table: each model's prediction, interval and CV metrics per scenario."""
    fitted, _, metrics = _group_models(spark, sf_dir)
    _, scen = _scen(spark, sf_dir)
    best = best_model(metrics).first()["model"]
    scored = S.score_scenarios(S.scenario_features(scen, codes=code_tables(spark, sf_dir)), fitted, metrics, best)
    return S.forecast_table(scored, metrics)


@register("w8_forecast_table")
def w8_forecast_table(spark, sf_dir):
    """The same table from the fitted MLlib models, with their empirical intervals."""
    _, fitted, _, metrics = _trained(spark, sf_dir)
    _, scen = _scen(spark, sf_dir)
    best = best_model(metrics).first()["model"]
    scored = S.score_scenarios(S.scenario_features(scen, codes=code_tables(spark, sf_dir)), fitted, metrics, best)
    return S.forecast_table(scored, metrics)


@register("w8_export_breakdown", sql=with_base(
    "SELECT scenario_id, channel_order, Channel, " + R6("Revenue") + " AS Revenue, " + R6("NetProfit")
    + " AS NetProfit, " + RN("Margin", 4) + " AS Margin FROM (" + _w6_body() + ") x",
    _SCEN_CTE))
def w8_export_breakdown(spark, sf_dir):
    _, scen = _scen(spark, sf_dir)
    b = report(S.channel_breakdown(scen))
    return b.withColumn("Margin", round_even("Margin", 4))


# --- W9 / T4 -------------------------------------------------------------------------------
def _pct(x, d):
    if d == 0:
        return f"format('{{:,.0f}}', {RN(x + ' * 100e0', 0)}) || '%'"
    return f"format('{{:,.{d}f}}', {RN(x + ' * 100e0', d)}) || '%'"


@register("w9_saved_comparison", sql=with_base(
    "SELECT \"user\", scenario_id, name, CAST(recency AS INT) AS recency, "
    + ", ".join(f"{_pct(c, 0)} AS \"{n}\"" for c, n in zip(SC, ["In-Store", "UE", "DD", "SD"])) + ", "
    + ", ".join(f"{_pct(c, 1)} AS {n}" for c, n in [("commission", "Commission"), ("cogs", "COGS"), ("opex", "OPEX")])
    + f", '$' || format('{{:,.2f}}', {RN('delivery_cost', 2)}) AS \"Del Cost\""
    + f", '$' || format('{{:,.0f}}', {RN('ue_profit', 0)}) AS Profit, {RN('ue_profit', 0)} AS profit_value, "
    "count(*) OVER (PARTITION BY \"user\") >= 2 AS comparable FROM ("
    f"SELECT scen.*, {_UE_PROFIT} AS ue_profit, row_number() OVER (PARTITION BY \"user\" "
    "ORDER BY _yr DESC, _mo DESC, _rid DESC, scenario_id DESC) AS recency FROM scen) x WHERE recency <= 5",
    _SCEN_CTE))
def w9_saved_comparison(spark, sf_dir):
    _, scen = _scen(spark, sf_dir)
    out = S.saved_comparison(S.unit_economics_profit(scen))
    return out.select("user", "scenario_id", "name", F.col("recency").cast("int").alias("recency"),
                      "In-Store", "UE", "DD", "SD", "Commission", "COGS", "OPEX", "Del Cost", "Profit",
                      "profit_value", "comparable")


@register("w9_group_model_comparison", sql=with_base(
    "SELECT \"user\", x.scenario_id, " + ", ".join(
        f"'$' || format('{{:,.0f}}', {RN(f'max(CASE WHEN model = {chr(39)}{n}{chr(39)} THEN pred END)', 0)}) AS \"{n} ($)\"" for n, _ in GROUP_MODELS)
    + f", max(CASE WHEN is_best THEN CASE WHEN (lower < 0 AND upper > 0) OR {_W5_WIDTH} >= 80e0 THEN 'High' "
    f"WHEN {_W5_WIDTH} >= 40e0 THEN 'Medium' ELSE 'Low' END END) AS Risk FROM (SELECT scenario_id, \"user\", row_number() OVER (PARTITION BY \"user\" "
    "ORDER BY _yr DESC, _mo DESC, _rid DESC, scenario_id DESC) AS recency FROM scen) x JOIN ri ON ri.scenario_id = x.scenario_id "
    "WHERE recency <= 5 GROUP BY 1, 2", *_GM_CTES, _SCEN_CTE, *_GROUP_SCORES))
def w9_group_model_comparison(spark, sf_dir):
    """Each saved scenario's prediction by every model, as display text, and the best model's risk."""
    fitted, _, metrics = _group_models(spark, sf_dir)
    _, scen = _scen(spark, sf_dir)
    best = best_model(metrics).first()["model"]
    saved = latest_per_group(scen, "user", "saved_at", KEEP_SAVED_SCENARIOS, "scenario_id")
    scored = S.score_scenarios(S.scenario_features(saved, codes=code_tables(spark, sf_dir)), fitted, metrics, best)
    return S.saved_forecasts(saved, scored, list(fitted))


# --- W10 -----------------------------------------------------------------------------------
_STEP = 1


def _w10_sql(step=_STEP):
    """Brute force over in-store and the two aggregators' common share: both earn the same, so
    the split between them is decided by the tie rule (the smallest Uber Eats share that fits)."""
    shares = list(zip(SC, ["InStoreShare", "UE_share", "DD_share", "SD_share"]))
    b0 = ", ".join(f"quantile_cont({c}, 0.1) AS lo_{s}, quantile_cont({c}, 0.9) AS hi_{s}, avg({c}) AS m_{s}"
                   for s, c in shares)
    tot = " + ".join(f"m_{s}" for s, _ in shares)
    b1 = ", ".join(f"m_{s} / ({tot}) AS base_{s}, "
                   f"CAST(ceil(lo_{s} * 100e0 / {step} - 1e-9) AS INT) * {step} AS ilo_{s}, "
                   f"CAST(floor(hi_{s} * 100e0 / {step} + 1e-9) AS INT) * {step} AS ihi_{s}" for s, _ in shares)
    grid = ("grid AS (SELECT a, b, c, 100 - a - b - c AS d FROM bnd, "
            "LATERAL (SELECT unnest(range(bnd.ilo_in_store, bnd.ihi_in_store + 1, {st})) AS a) ta, "
            "LATERAL (SELECT greatest(ilo_ue_share, m - ihi_dd_share) AS b, m - greatest(ilo_ue_share, m - ihi_dd_share) AS c "
            "FROM (SELECT unnest(range(bnd.ilo_ue_share + bnd.ilo_dd_share, "
            "least(bnd.ihi_ue_share + bnd.ihi_dd_share, 100 - ta.a) + 1, {st})) AS m) u) tb "
            "WHERE 100 - a - b - c >= bnd.ilo_sd_share AND 100 - a - b - c <= bnd.ihi_sd_share)").format(st=step)
    cand = ("cand AS (SELECT scenario_id, a, b, c, d, " + _UE_PROFIT + " AS obj FROM ("
            "SELECT scen.* EXCLUDE (in_store, ue_share, dd_share, sd_share), a, b, c, d, a / 100e0 AS in_store, "
            "b / 100e0 AS ue_share, c / 100e0 AS dd_share, d / 100e0 AS sd_share FROM scen, grid) x)")
    best = ("best AS (SELECT scenario_id, p.a AS a, p.b AS b, p.c AS c, p.d AS d, p.obj AS obj FROM (SELECT scenario_id, "
            "arg_max({'a': a, 'b': b, 'c': c, 'd': d, 'obj': obj}, [obj, -a, -b, -c]) AS p FROM cand GROUP BY scenario_id) y)")
    base = ("basel AS (SELECT scenario_id, base_in_store, base_ue_share, base_dd_share, base_sd_share, "
            + _UE_PROFIT + " AS bobj FROM (SELECT scen.* EXCLUDE (in_store, ue_share, dd_share, sd_share), "
            "base_in_store, base_ue_share, base_dd_share, base_sd_share, base_in_store AS in_store, "
            "base_ue_share AS ue_share, base_dd_share AS dd_share, base_sd_share AS sd_share FROM scen, bnd) z)")
    final = ("SELECT basel.scenario_id, " + R6("bobj") + " AS baseline_objective, "
             + ", ".join(f"{R6(f'base_{s}')} AS baseline_{s}" for s in SC) + ", "
             + R6("obj") + " AS opt_objective, "
             + ", ".join(f"{R6(f'{v} / 100e0')} AS opt_{s}" for v, s in zip("abcd", SC))
             + ", obj IS NOT NULL AS feasible, " + R6("obj - bobj") + " AS uplift "
             "FROM basel LEFT JOIN best ON best.scenario_id = basel.scenario_id")
    return with_base(final, _SCEN_CTE, f"bnd0 AS (SELECT {b0} FROM t)", f"bnd AS (SELECT *, {b1} FROM bnd0)",
                     grid, cand, best, base)


@register("w10_optimise_unit_economics", sql=_w10_sql())
def w10_optimise_unit_economics(spark, sf_dir):
    bt, scen = _scen(spark, sf_dir)
    return report(O.optimise_unit_economics(scen, bt, step_pct=_STEP))


@register("w10_optimise_with_model")
def w10_optimise_with_model(spark, sf_dir):
    _, fitted, _, metrics = _trained(spark, sf_dir)
    best = best_model(metrics).first()["model"]
    bt, scen = _scen(spark, sf_dir)
    # codes are joined per scenario before the candidate fan-out
    return O.optimise_with_model(S.attach_codes(scen, codes=code_tables(spark, sf_dir)), bt, fitted[best], S.feature_columns, step_pct=_STEP)


_BOUNDS = "bnd0 AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.1) AS lo_{s}, quantile_cont({c}, 0.9) AS hi_{s}, avg({c}) AS m_{s}"
                                         for s, c in zip(SC, ["InStoreShare", "UE_share", "DD_share", "SD_share"])) + " FROM t)"
_REAL = ("bnd AS (SELECT *, " + ", ".join(f"m_{s} / (" + " + ".join(f"m_{x}" for x in SC) + f") AS base_{s}" for s in SC) + " FROM bnd0)")
_IN_RANGE = " AND ".join(f"base_{s} BETWEEN lo_{s} - 1e-9 AND hi_{s} + 1e-9" for s in SC)
#: An optimum is a corner: three shares at a bound, the fourth takes what is left. Objectives are compared at cents.
_CORNERS = ("corners AS (SELECT * FROM (" + " UNION ALL ".join(
    "SELECT " + ", ".join((f"1e0 - ({' + '.join(f'CASE WHEN k{i} THEN lo_{x} ELSE hi_{x} END' for i, x in enumerate(SC) if x != f)}) AS {s}")
                          if s == f else f"CASE WHEN k{n} THEN lo_{s} ELSE hi_{s} END AS {s}" for n, s in enumerate(SC))
    + " FROM bnd, " + ", ".join(f"(VALUES (true), (false)) v{n}(k{n})" for n in range(4)) for f in SC) + ") x, "
    "(SELECT * EXCLUDE (" + ", ".join(f"m_{s}" for s in SC) + ") FROM bnd) y WHERE " + " AND ".join(f"x.{s} BETWEEN lo_{s} - 1e-9 AND hi_{s} + 1e-9" for s in SC) + ")")
_EXACT = [_SCEN_CTE, _BOUNDS, _REAL, _CORNERS,
          "cand AS (SELECT scenario_id, in_store, ue_share, dd_share, sd_share, " + _UE_PROFIT + " AS obj FROM "
          "(SELECT scen.* EXCLUDE (in_store, ue_share, dd_share, sd_share), " + ", ".join(f"corners.{s}" for s in SC) + " FROM scen, corners) z)",
          "opt AS (SELECT scenario_id, " + ", ".join(f"{s} AS opt_{s}" for s in SC) + ", obj FROM cand QUALIFY row_number() OVER (PARTITION BY "
          "scenario_id ORDER BY round(obj, 4) DESC, " + ", ".join(f"round({s}, 9)" for s in SC) + ") = 1)",
          "basel AS (SELECT scenario_id, " + ", ".join(f"{s} AS baseline_{s}" for s in SC) + ", baseline_in_range, " + _UE_PROFIT + " AS bobj FROM "
          "(SELECT scen.* EXCLUDE (in_store, ue_share, dd_share, sd_share), " + ", ".join(f"base_{s} AS {s}" for s in SC)
          + f", ({_IN_RANGE}) AS baseline_in_range FROM scen, bnd) z)"]


@register("w10_exact_optimum", sql=with_base(
    "SELECT b.scenario_id, CASE WHEN obj IS NULL THEN 'none' ELSE 'optimal' END AS status, " + R6("bobj") + " AS baseline_objective, "
    + ", ".join(f"{R6(f'baseline_{s}')} AS baseline_{s}" for s in SC) + ", baseline_in_range, " + R6("obj") + " AS opt_objective, "
    + ", ".join(f"{R6(f'opt_{s}')} AS opt_{s}" for s in SC) + ", " + R6("obj - bobj") + " AS uplift "
    "FROM basel b LEFT JOIN opt ON opt.scenario_id = b.scenario_id", *_EXACT))
def w10_exact_optimum(spark, sf_dir):
    """The unit-economics optimum on the real observed ranges, with baseline, uplift and status."""
    bt, scen = _scen(spark, sf_dir)
    return report(O.optimise_exact(scen, bt))


@register("w10_mix_report", sql=with_base(
    "SELECT b.scenario_id, i AS channel_order, ['In-Store', 'Uber Eats', 'DoorDash', 'Self-Delivery'][i + 1] AS Channel, "
    + ", ".join(R6("[" + ", ".join(f"{p}_{s}" for s in SC) + "][i + 1]") + f" AS {n}" for p, n in
                (("baseline", "Baseline"), ("opt", "Optimized"), ("lo", "safe_low"), ("hi", "safe_high")))
    + ", " + " || '% to ' || ".join("CAST(CAST(" + RN("[" + ", ".join(f"{p}_{s}" for s in SC) + "][i + 1] * 100e0", 0) + " AS BIGINT) AS VARCHAR)" for p in ("lo", "hi"))
    + " || '%' AS safe_range FROM basel b JOIN opt ON opt.scenario_id = b.scenario_id, bnd, (SELECT CAST(unnest(range(4)) AS INT) AS i) r", *_EXACT))
def w10_mix_report(spark, sf_dir):
    bt, scen = _scen(spark, sf_dir)
    return report(O.mix_report(O.optimise_exact(scen, bt), bt))


#: Split points of the checked step model.
_POINTS = {"InStoreShare": [0.15, 0.3, 0.45, 0.6], "SD_share": [0.1, 0.25, 0.4], "DeliveryCost_SD": [0.5, 1.0]}


def _bin_sql(exprs):
    return ", ".join("(" + " + ".join(f"CASE WHEN {e} > {t}e0 THEN 1 ELSE 0 END" for t in ts) + f") AS b{i}" for i, (e, ts) in enumerate(zip(exprs, _POINTS.values())))


def _w10_steps_sql():
    """Brute force over the grid. The prediction depends on in-store and self-delivery alone, so of the
    splits between the two aggregators only the first can win."""
    ints = ", ".join(f"CAST(ceil(lo_{s} * 100e0 - 1e-9) AS INT) AS ilo_{s}, CAST(floor(hi_{s} * 100e0 + 1e-9) AS INT) AS ihi_{s}" for s in SC)
    grid = ("grid AS (SELECT * FROM (SELECT a, d, greatest(ilo_ue_share, 100 - a - d - ihi_dd_share) AS b, "
            "100 - a - d - greatest(ilo_ue_share, 100 - a - d - ihi_dd_share) AS c, ihi_ue_share, ilo_dd_share, ihi_dd_share FROM bi, "
            "LATERAL (SELECT unnest(range(ilo_in_store, ihi_in_store + 1)) AS a) ta, LATERAL (SELECT unnest(range(ilo_sd_share, ihi_sd_share + 1)) AS d) td) g "
            "WHERE b <= ihi_ue_share AND c BETWEEN ilo_dd_share AND ihi_dd_share)")
    train = "(SELECT * FROM sp WHERE NOT is_test)"
    bins = _bin_sql(["in_store", "sd_share", "delivery_cost * sd_share"])
    final = ("SELECT o.scenario_id, " + R6("bp") + " AS baseline_objective, baseline_in_range, " + R6("CASE WHEN stay THEN bp ELSE p END") + " AS opt_objective, "
             + ", ".join(R6(f"CASE WHEN stay THEN base_{s} ELSE {v} / 100e0 END") + f" AS opt_{s}" for v, s in zip("abcd", SC))
             + " FROM (SELECT g.*, b.p AS bp, " + _IN_RANGE + " AS baseline_in_range, (" + _IN_RANGE + ") AND b.p > g.p AS stay, "
             + ", ".join(f"base_{s}" for s in SC) + " FROM (SELECT * FROM scored WHERE a IS NOT NULL QUALIFY row_number() OVER "
             "(PARTITION BY scenario_id ORDER BY p DESC, a, b, c) = 1) g JOIN scored b ON b.scenario_id = g.scenario_id AND b.a IS NULL, bnd) o")
    return with_base(
        final, *_PREP_CTES, _SCEN_CTE, _BOUNDS, _REAL, f"bi AS (SELECT *, {ints} FROM bnd)", grid,
        f"means AS (SELECT b0, b1, b2, avg(label) AS m FROM (SELECT label, {_bin_sql(['InStoreShare', 'SD_share', 'DeliveryCost_SD'])} FROM {train} z) y GROUP BY 1, 2, 3)",
        "mixes AS (SELECT a, b, c, d, a / 100e0 AS in_store, d / 100e0 AS sd_share FROM grid UNION ALL SELECT NULL, NULL, NULL, NULL, base_in_store, base_sd_share FROM bnd)",
        f"cells AS (SELECT scenario_id, a, b, c, d, {bins} FROM (SELECT scenario_id, delivery_cost FROM scen) s, mixes)",
        f"scored AS (SELECT c.*, coalesce(m.m, (SELECT avg(label) FROM {train} z)) AS p FROM cells c LEFT JOIN means m "
        "ON m.b0 = c.b0 AND m.b1 = c.b1 AND m.b2 = c.b2)")


@register("w10_step_model_optimum", sql=_w10_steps_sql())
def w10_step_model_optimum(spark, sf_dir):
    """The model objective at 1 % through cells, on a model of bin means that SQL can scan in full."""
    prep = prepared_table(spark, sf_dir)
    model = fit_bin_mean("Bin Mean", prep.where(~F.col("is_test")), _POINTS)
    bt, scen = _scen(spark, sf_dir)
    out = O.optimise_with_model(S.attach_codes(scen, codes=code_tables(spark, sf_dir)), bt, model, S.feature_columns, step_pct=_STEP)
    return report(out.select("scenario_id", "baseline_objective", "baseline_in_range", "opt_objective", *[f"opt_{s}" for s in SC]))


# --- W11 ------------------------------------------------------------------------------------
def _rec_row(n, title, best, v1, v2=None, v3=None):
    none_d = F.lit(None).cast("double")
    return [F.lit(n).alias("n"), F.lit(title).alias("title"),
            (best if best is not None else F.lit(None).cast("string")).alias("best"),
            v1.alias("value_1"), (v2 if v2 is not None else none_d).alias("value_2"),
            (v3 if v3 is not None else none_d).alias("value_3")]


def _recommendation_facts(bt):
    """Data-driven recommendation rows 1-6 and the fixed cost targets (row 8)."""
    ch = A.channel_means(bt).where(F.col("Channel") == "In-Store")
    be = bt.agg(F.max(F.when(F.col("UberEatsNetProfit") > 0, F.col("CommissionRate"))).alias("be"))
    sd = A.self_delivery_thresholds(bt)
    groups = A.best_groups(bt)
    rows = [ch.select(*_rec_row(1, "Channel Optimization", F.lit("In-Store"), F.col("avg_profit"))),
            be.select(*_rec_row(2, "Commission Negotiation", None, F.col("be"))),
            sd.select(*_rec_row(3, "Self-Delivery Expansion", None, F.col("max_profitable_cost"),
                                F.col("max_profitable_radius").cast("double"), F.col("profitable_pct")))]
    for i, (dim, title) in enumerate([("Segment", "Best Performing Segment"), ("Subregion", "Subregion Focus"),
                                      ("CuisineType", "Cuisine Mix Strategy")], start=4):
        rows.append(groups.where(F.col("dimension") == dim).select(*_rec_row(i, title, F.col("best"),
                                                                             F.col("mean_value"))))
    rows.append(be.select(*_rec_row(8, "Cost Structure Management", None, F.lit(TARGET_COST_TO_REVENUE),
                                    F.lit(TARGET_COGS), F.lit(TARGET_OPEX))))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def _w11_sql():
    nd = "CAST(NULL AS DOUBLE)"
    ns = "CAST(NULL AS VARCHAR)"
    parts = [
        f"SELECT 1 AS n, 'Channel Optimization' AS title, 'In-Store' AS best, {R6('avg(InStoreNetProfit)')} AS value_1, "
        f"{nd} AS value_2, {nd} AS value_3 FROM t",
        f"SELECT 2, 'Commission Negotiation', {ns}, {R6('max(CASE WHEN UberEatsNetProfit > 0 THEN CommissionRate END)')}, "
        f"{nd}, {nd} FROM t",
        f"SELECT 3, 'Self-Delivery Expansion', {ns}, "
        f"{R6('max(CASE WHEN SelfDeliveryNetProfit > 0 THEN DeliveryCostPerOrder END)')}, "
        "CAST(max(CASE WHEN SelfDeliveryNetProfit > 0 THEN DeliveryRadiusKM END) AS DOUBLE), "
        f"{R6('avg(CASE WHEN COALESCE(SelfDeliveryNetProfit > 0, false) THEN 1e0 ELSE 0e0 END) * 100e0')} FROM t",
    ]
    for i, (dim, title) in enumerate([("Segment", "Best Performing Segment"), ("Subregion", "Subregion Focus"),
                                      ("CuisineType", "Cuisine Mix Strategy")], start=4):
        parts.append(f"SELECT * FROM (SELECT {i}, '{title}', {dim}, {R6('avg(TotalNetProfit)')}, {nd}, {nd} FROM t "
                     f"WHERE {dim} IS NOT NULL GROUP BY {dim} ORDER BY avg(TotalNetProfit) DESC NULLS LAST, {dim} LIMIT 1)")
    parts.append(f"SELECT 8, 'Cost Structure Management', {ns}, 70e0, 28e0, 40e0")
    return with_base(" UNION ALL ".join(parts))


@register("w11_recommendation_facts", sql=_w11_sql())
def w11_recommendation_facts(spark, sf_dir):
    return report(_recommendation_facts(_bt(spark, sf_dir)))


@register("w11_recommendations")
def w11_recommendations(spark, sf_dir):
    """All eight recommendation rows, including the best fitted model (row 7)."""
    bt = _bt(spark, sf_dir)
    _, _, _, metrics = _trained(spark, sf_dir)
    bm = best_model(metrics).select("model", "R2")
    model_row = bm.select(*_rec_row(7, "Predictive Model Adoption", F.col("model"), F.col("R2"),
                                    F.col("R2") * 100.0))
    return _recommendation_facts(bt).unionByName(model_row)
