"""What-if scenarios scored in bulk.

A scenario is a row of the scenarios table (schema.SCENARIO); every
operator is a projection, a per-row generator (sweep points, channels) or a
small grouped aggregate, so N scenarios cost one job instead of N x 30
single-row predictions. Category codes come from the fact table's code
tables (one row per category value), joined by value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.compat import money, parse_money, percent, round_even
from ..ml.prepare import code_table
from ..operators.ranking import latest_per_group
from ..schema import (CATEGORY_COLS, CHANNELS, FEATURES, KEEP_SAVED_SCENARIOS, RISK_HIGH_WIDTH,
                      RISK_MEDIUM_WIDTH, SHARE_SUM_TOLERANCE, SWEEP_HI, SWEEP_LO, SWEEP_POINTS)
from ..session import broadcast_if_small

SCEN_CATS = {"CuisineType": "cuisine", "Segment": "segment", "Subregion": "subregion"}


def attach_codes(scen: DataFrame, outlets: DataFrame | None = None, codes: dict | None = None) -> DataFrame:
    """Category codes for the scenario's cuisine / segment / subregion, learnt
    from the fact table (one code table row per category value). An unknown
    category gets a NULL code and ``feature_error`` set."""
    codes = codes or {k: code_table(outlets, k) for k in CATEGORY_COLS}
    out, err = scen, None
    for cat, scol in SCEN_CATS.items():
        t = broadcast_if_small(codes[cat]).withColumnRenamed(cat, "_v")     # one row per category value
        out = out.join(t, out[scol] == t["_v"], "left").drop("_v")
        miss = F.when(F.col(cat + "_enc").isNull(), F.lit(f"unknown {scol}"))
        err = miss if err is None else F.coalesce(err, miss)
    return out.withColumn("feature_error", err)


def split_errors(feats: DataFrame):
    """(scorable rows, rows with a ``feature_error`` or None if the column is absent)."""
    if "feature_error" not in feats.columns:
        return feats, None
    return feats.where("feature_error IS NULL"), feats.where("feature_error IS NOT NULL")


def feature_columns(scen: DataFrame) -> DataFrame:
    """The 22 numeric model features from scenario inputs (a projection)."""
    c = {k: F.col(k) for k in ["in_store", "ue_share", "dd_share", "sd_share", "commission",
                               "delivery_cost", "radius", "growth", "aov", "orders", "cogs", "opex"]}
    rev = c["aov"] * c["orders"]
    rev_ue, rev_dd = rev * c["ue_share"], rev * c["dd_share"]
    ppo_num = (rev * (F.lit(1.0) - c["cogs"] - c["opex"]) - rev_ue * c["commission"]
               - rev_dd * c["commission"] - c["delivery_cost"] * c["orders"] * c["sd_share"])
    ratio = lambda share: F.when(rev != 0, (rev * share) / rev).otherwise(F.lit(0.0))
    return scen.withColumns({
        "InStoreShare": c["in_store"], "UE_share": c["ue_share"], "DD_share": c["dd_share"],
        "SD_share": c["sd_share"], "CommissionRate": c["commission"],
        "DeliveryCostPerOrder": c["delivery_cost"], "DeliveryRadiusKM": c["radius"].cast("double"),
        "GrowthFactor": c["growth"], "AOV": c["aov"], "MonthlyOrders": c["orders"].cast("double"),
        "COGSRate": c["cogs"], "OPEXRate": c["opex"],
        "Commission_UE": c["commission"] * c["ue_share"],
        "DeliveryCost_SD": c["delivery_cost"] * c["sd_share"],
        "GrowthAdj_Orders": c["orders"] * c["growth"],
        "CostToRevenue": c["cogs"] + c["opex"],
        "InStoreRevRatio": ratio(c["in_store"]), "UE_RevRatio": ratio(c["ue_share"]),
        "DD_RevRatio": ratio(c["dd_share"]), "SD_RevRatio": ratio(c["sd_share"]),
        "RevenuePerOrder": c["aov"],
        "ProfitPerOrder": F.when(c["orders"] != 0, ppo_num / c["orders"]).otherwise(F.lit(0.0)),
    })


def scenario_features(scen: DataFrame, outlets: DataFrame | None = None,
                      codes: dict | None = None) -> DataFrame:
    """The 25 model features from scenario inputs (named as FEATURES).

    ``codes`` maps category column -> code table; by default they are learnt
    from ``outlets``. A scenario with an unknown category gets a NULL code
    and ``feature_error`` set.
    """
    return feature_columns(attach_codes(scen, outlets, codes))


def share_check(scen: DataFrame, tol: float = SHARE_SUM_TOLERANCE) -> DataFrame:
    """Total of the four shares and the 'not close to 1' warning."""
    total = F.col("in_store") + F.col("ue_share") + F.col("dd_share") + F.col("sd_share")
    return scen.withColumns({"share_total": total, "share_warning": F.abs(total - F.lit(1.0)) > tol})


def risk_label(lower, upper, pred):
    """(risk, width_pct) columns from an interval and a prediction."""
    lo, up, p = [F.col(x) if isinstance(x, str) else x for x in (lower, upper, pred)]
    width = (up - lo) / F.greatest(F.abs(p), F.lit(1.0)) * 100.0
    risk = (F.when(((lo < 0) & (up > 0)) | (width >= RISK_HIGH_WIDTH), F.lit("High"))
            .when(width >= RISK_MEDIUM_WIDTH, F.lit("Medium")).otherwise(F.lit("Low")))
    return risk.alias("risk"), width.alias("width_pct")


def channel_breakdown(scen: DataFrame, key: str = "scenario_id") -> DataFrame:
    """Revenue, net profit and margin per scenario x channel (4 rows each)."""
    orders, aov = F.col("orders"), F.col("aov")
    keep = F.lit(1.0) - F.col("cogs") - F.col("opex")
    comm = F.col("commission")
    rows = []
    for i, (ch, share) in enumerate(zip(CHANNELS, ["in_store", "ue_share", "dd_share", "sd_share"])):
        rev = aov * orders * F.col(share)
        if ch in ("Uber Eats", "DoorDash"):
            prof = rev * (keep - comm)
        elif ch == "Self-Delivery":
            prof = rev * keep - F.col("delivery_cost") * (orders * F.col(share))
        else:
            prof = rev * keep
        rows.append(F.struct(F.lit(i).alias("channel_order"), F.lit(ch).alias("Channel"),
                             rev.alias("Revenue"), prof.alias("NetProfit"),
                             F.when(rev != 0, prof / rev).otherwise(F.lit(0.0)).alias("Margin")))
    return scen.select(key, F.inline(F.array(*rows)))


def unit_economics_profit(scen: DataFrame) -> DataFrame:
    """Total of the W6 channel profits per scenario (a formula, no model)."""
    orders, aov = F.col("orders"), F.col("aov")
    rev = aov * orders
    keep = F.lit(1.0) - F.col("cogs") - F.col("opex")
    prof = (rev * F.col("in_store") * keep + rev * F.col("ue_share") * (keep - F.col("commission"))
            + rev * F.col("dd_share") * (keep - F.col("commission"))
            + (rev * F.col("sd_share") * keep - F.col("delivery_cost") * (orders * F.col("sd_share"))))
    return scen.withColumn("ue_profit", prof)


def sweep_points(lo: float = SWEEP_LO, hi: float = SWEEP_HI, n: int = SWEEP_POINTS):
    """``linspace(lo, hi, n)`` as an array column (last point exactly ``hi``)."""
    step = (hi - lo) / (n - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)),
                       lambda i: F.when(i == n - 1, F.lit(hi)).otherwise(F.lit(lo) + i.cast("double") * F.lit(step)))


def commission_sweep(scen: DataFrame, n: int = SWEEP_POINTS) -> DataFrame:
    """Each scenario repeated at ``n`` commission rates (a per-row generator).

    Join anything per scenario (codes) before the fan-out, then recompute the
    commission-dependent features with :func:`feature_columns`."""
    return (scen.select("*", F.posexplode(sweep_points(n=n)).alias("sweep_idx", "_cr"))
            .withColumn("commission", F.col("_cr")).drop("_cr"))


def saved_comparison(saved: DataFrame, keep: int = KEEP_SAVED_SCENARIOS) -> DataFrame:
    """W9 + T4: newest ``keep`` saved scenarios per user, displayed as text and
    with the profit parsed back to a number; ``comparable`` needs >= 2 per user."""
    latest = latest_per_group(saved, "user", "saved_at", keep, "scenario_id")
    text = latest.select(
        "user", "scenario_id", "name", "saved_at", "recency",
        percent("in_store").alias("In-Store"), percent("ue_share").alias("UE"),
        percent("dd_share").alias("DD"), percent("sd_share").alias("SD"),
        percent("commission", 1).alias("Commission"), percent("cogs", 1).alias("COGS"),
        percent("opex", 1).alias("OPEX"), money("delivery_cost", 2).alias("Del Cost"), money("ue_profit").alias("Profit"))
    from pyspark.sql import Window
    w = Window.partitionBy("user")   # at most `keep` rows per user after the filter
    return text.withColumns({"profit_value": parse_money("Profit"),
                             "comparable": F.count(F.lit(1)).over(w) >= 2})


def forecast_table(scored: DataFrame, metrics: DataFrame, key: str = "scenario_id") -> DataFrame:
    """Each model's prediction and interval per scenario with its CV metrics, rounded for export."""
    cv = metrics.select("model", "CV_RMSE_mean", "CV_R2_mean", "CV_MAE_mean")       # one row per model
    out = scored.join(F.broadcast(cv), "model")
    return out.select(key, F.col("model").alias("Model"), round_even("pred", 2).alias("predicted_net_profit"),
                      round_even("lower", 2).alias("p2_5"), round_even("upper", 2).alias("p97_5"),
                      round_even("CV_RMSE_mean", 2).alias("cv_rmse_mean"), round_even("CV_R2_mean", 4).alias("cv_r2_mean"),
                      round_even("CV_MAE_mean", 2).alias("cv_mae_mean"))


# Labels of the exported inputs (fixed values) and the scenario columns they show.
EXPORT_INPUTS = [
    ("In-Store Share", "in_store"), ("Uber Eats Share", "ue_share"), ("DoorDash Share", "dd_share"),
    ("Self-Delivery Share", "sd_share"), ("Commission Rate", "commission"), ("Delivery Cost/Order", "delivery_cost"),
    ("Delivery Radius (km)", "radius"), ("Growth Factor", "growth"), ("Cuisine Type", "cuisine"), ("Segment", "segment"),
    ("Subregion", "subregion"), ("Avg Order Value", "aov"), ("Monthly Orders", "orders"), ("COGS Rate", "cogs"), ("OPEX Rate", "opex")]


def export_summary(scen: DataFrame, scored: DataFrame, best: str, key: str = "scenario_id") -> DataFrame:
    """R4 + P12: every scenario's inputs, best model, its risk, and each model's forecast as text rows
    (Section, Metric, Value). ``scored`` is :func:`score_scenarios`' result and is read once; a scenario that
    could not be scored keeps its rows, with NULL risk and forecasts."""
    row = lambda section, metric, value: F.struct(
        F.lit(section).alias("Section"), metric.alias("Metric"), value.cast("string").alias("Value"))
    inputs = scen.select(key, F.inline(F.array(
        *[row("Scenario Inputs", F.lit(label), F.col(c)) for label, c in EXPORT_INPUTS],
        row("Scenario Inputs", F.lit("Best Model"), F.lit(best)))))
    forecast = row("Model Forecasts", F.col("model"), round_even("pred", 2))
    risk = row("Scenario Inputs", F.lit("Best-Model Risk"), F.col("risk"))
    return inputs.unionByName(scored.select(key, F.inline(F.when(F.col("is_best"), F.array(forecast, risk)).otherwise(F.array(forecast)))))


def sweep_predictions(scen: DataFrame, model, band=None, codes: dict | None = None, n: int = SWEEP_POINTS,
                      features=FEATURES, key: str = "scenario_id") -> DataFrame:
    """``model`` at every commission rate of the sweep; ``band`` maps (rows with features) to the same rows with
    ``band_lower`` and ``band_upper``. Codes are joined before the fan-out. Money and per cent at 2 decimals."""
    feats = feature_columns(commission_sweep(split_errors(attach_codes(scen, codes=codes))[0], n))
    keep = [key, "sweep_idx", "commission", "segment"]
    out = model.predict(feats, keep=[*keep, *features])
    shown = [key, "sweep_idx", round_even(F.col("commission") * 100.0, 2).alias("commission_pct"), round_even("pred", 2).alias("pred")]
    if band is not None:
        out = band(out)
        shown += [round_even("band_lower", 2).alias("p2_5"), round_even("band_upper", 2).alias("p97_5")]
    return out.select(*shown)


def saved_forecasts(saved: DataFrame, scored: DataFrame, models: list, key: str = "scenario_id") -> DataFrame:
    """Every model's prediction of the saved scenarios as text, and the best model's risk."""
    wide = scored.groupBy(key).agg(
        *[money(F.max(F.when(F.col("model") == m, F.col("pred")))).alias(f"{m} ($)") for m in models],
        F.max(F.when(F.col("is_best"), F.col("risk"))).alias("Risk"))
    return saved.select("user", key).join(wide, key)


def score_scenarios(feats: DataFrame, fitted: dict, metrics: DataFrame, best: str,
                    band: DataFrame | None = None, key: str = "scenario_id") -> DataFrame:
    """W3 + W4 + W5: every fitted model scores every scenario (one ``transform``
    per model, unioned long); the best model's interval is the quantile
    ``band`` (``key, band_lower, band_upper``; the empirical one if absent),
    the others use ``pred + residual_low .. pred + residual_high``; risk per row.
    A scenario with a ``feature_error`` gets one row per model with NULL results, and
    does not fail the others.
    """
    ok, bad = split_errors(feats)
    long = None
    for m in fitted:
        p = fitted[m].predict(ok, keep=[key]).withColumn("model", F.lit(m))
        long = p if long is None else long.unionByName(p)
    if bad is not None:
        names = F.explode(F.array(*[F.lit(m) for m in fitted])).alias("model")
        long = long.unionByName(bad.select(key, names), allowMissingColumns=True)
    off = metrics.select("model", "residual_low", "residual_high")     # one row per model (a fixed list)
    out = long.join(F.broadcast(off), "model")
    is_best = F.col("model") == F.lit(best)
    lo_emp, hi_emp = F.col("pred") + F.col("residual_low"), F.col("pred") + F.col("residual_high")
    if band is not None:
        out = out.join(band.select(key, "band_lower", "band_upper"), key, "left")
        lo = F.when(is_best, F.col("band_lower")).otherwise(lo_emp)
        hi = F.when(is_best, F.col("band_upper")).otherwise(hi_emp)
    else:
        lo, hi = lo_emp, hi_emp
    out = out.withColumns({"is_best": is_best, "lower": lo, "upper": hi})
    risk, width = risk_label("lower", "upper", "pred")
    return out.select(key, "model", "is_best", "pred", "lower", "upper",
                      F.when(F.col("pred").isNotNull(), risk).alias("risk"), width)
