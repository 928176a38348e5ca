"""Registered queries for aggregates (A*), reshapes (R*), sort/limit.

Each query reads the driver tables through the outlet-month table and runs
over all rows; its DuckDB twin shares the fixture/feature CTEs.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import ranking
from ..schema import KEY_COLS, SHARE_COLS
from .catalog import base_table, register, report
from .sqlbase import (BIN_EDGE, BIN_IDX, COMM_BUCKET, COMM_BUCKET_IDX, CORR, EDGES_CTE, PD_DIV,
                      R6, RN, with_base)

KEY = "RestaurantID, Yr, Mo"
CH = [("In-Store", "InStoreShare", "InStoreRevenue", "InStoreNetProfit"),
      ("Uber Eats", "UE_share", "UberEatsRevenue", "UberEatsNetProfit"),
      ("DoorDash", "DD_share", "DoorDashRevenue", "DoorDashNetProfit"),
      ("Self-Delivery", "SD_share", "SelfDeliveryRevenue", "SelfDeliveryNetProfit")]


def _bt(spark, sf_dir):
    return base_table(spark, sf_dir)


# --- S7 ------------------------------------------------------------------------
@register("s7_preview_50", sql=with_base(
    f"SELECT {KEY}, RestaurantName, CuisineType, Segment, Subregion, {R6('TotalRevenue')} AS TotalRevenue, "
    f"{R6('TotalNetProfit')} AS TotalNetProfit FROM t ORDER BY {KEY} LIMIT 50"))
def s7_preview_50(spark, sf_dir):
    t = _bt(spark, sf_dir).orderBy(*KEY_COLS).limit(50)
    return report(t.select(*KEY_COLS, "RestaurantName", "CuisineType", "Segment", "Subregion",
                           "TotalRevenue", "TotalNetProfit"))


# --- A1, A2 ------------------------------------------------------------------------
@register("a1_kpi_summary", sql=with_base(
    f"SELECT CAST(count(DISTINCT RestaurantID) AS BIGINT) AS n_restaurants, {R6('avg(MonthlyOrders)')} AS avg_orders, "
    f"{R6('avg(TotalNetProfit)')} AS avg_profit, {R6('avg(OverallMargin) * 100e0')} AS avg_margin_pct, "
    f"{R6('avg(CommissionRate) * 100e0')} AS avg_commission_pct FROM t"))
def a1_kpi_summary(spark, sf_dir):
    return report(A.kpi_summary(_bt(spark, sf_dir)))


@register("a2_outlier_summary", sql=with_base(
    "SELECT CAST(sum(CASE WHEN IsOutlier THEN 1 ELSE 0 END) AS BIGINT) AS n_outliers, "
    f"CAST(count(*) AS BIGINT) AS n_rows, {R6('avg(CAST(IsOutlier AS DOUBLE)) * 100e0')} AS outlier_pct FROM t"))
def a2_outlier_summary(spark, sf_dir):
    return report(A.outlier_summary(_bt(spark, sf_dir)))


# --- A3, A4, A6, A11 --------------------------------------------------------------
def _gm_sql(by, cols):
    keys = ", ".join(by)
    nn = " AND ".join(f"{b} IS NOT NULL" for b in by)
    sel = ", ".join(f"{R6(f'avg({c})')} AS avg_{c}" for c in cols)
    return with_base(f"SELECT {keys}, {sel} FROM t WHERE {nn} GROUP BY {keys}")


@register("a3_revenue_by_cuisine", sql=_gm_sql(["CuisineType"], ["TotalRevenue"]))
def a3_revenue_by_cuisine(spark, sf_dir):
    return report(A.group_means(_bt(spark, sf_dir), "CuisineType", "TotalRevenue")
                  .orderBy("avg_TotalRevenue"))


@register("a4_profit_by_segment", sql=_gm_sql(["Segment"], ["TotalNetProfit"]))
def a4_profit_by_segment(spark, sf_dir):
    return report(A.group_means(_bt(spark, sf_dir), "Segment", "TotalNetProfit")
                  .orderBy("avg_TotalNetProfit"))


@register("a6_subregion_means", sql=_gm_sql(["Subregion"], ["TotalRevenue", "TotalNetProfit"]))
def a6_subregion_means(spark, sf_dir):
    return report(A.group_means(_bt(spark, sf_dir), "Subregion", ["TotalRevenue", "TotalNetProfit"]))


@register("a11_profit_cuisine_segment", sql=_gm_sql(["CuisineType", "Segment"], ["TotalNetProfit"]))
def a11_profit_cuisine_segment(spark, sf_dir):
    return report(A.group_means(_bt(spark, sf_dir), ["CuisineType", "Segment"], "TotalNetProfit"))


# --- A5, A8, A12, A13 -------------------------------------------------------------
def _channel_long_sql(select_cols: str, tail: str = "") -> str:
    aggs = ", ".join(f"avg({s}) AS {s}, avg({r}) AS {r}, avg({p}) AS {p}" for _, s, r, p in CH)
    rows = " UNION ALL ".join(
        f"SELECT {i} AS channel_order, '{ch}' AS Channel, {s} AS avg_share, {r} AS avg_revenue, "
        f"{p} AS avg_profit FROM m" for i, (ch, s, r, p) in enumerate(CH))
    return with_base(f"SELECT {select_cols} FROM ({rows}) c {tail}", f"m AS (SELECT {aggs} FROM t)")


@register("a13_channel_summary", sql=_channel_long_sql(
    f"channel_order, Channel, {R6('avg_share')} AS avg_share, {R6('avg_revenue')} AS avg_revenue, "
    f"{R6('avg_profit')} AS avg_profit"))
def a13_channel_summary(spark, sf_dir):
    return report(A.channel_means(_bt(spark, sf_dir)))


@register("a5_channel_mix", sql=_channel_long_sql(
    f"channel_order, Channel, {R6('avg_share')} AS avg_share"))
def a5_channel_mix(spark, sf_dir):
    return report(A.channel_mix(_bt(spark, sf_dir)))


@register("a8_best_channel", sql=_channel_long_sql(
    f"Channel, {R6('avg_profit')} AS avg_profit", "ORDER BY avg_profit DESC NULLS LAST, channel_order LIMIT 1"))
def a8_best_channel(spark, sf_dir):
    return report(A.best_channel(_bt(spark, sf_dir)))


@register("a12_channel_efficiency", sql=with_base(
    f"SELECT channel_order, Channel, {R6('efficiency')} AS efficiency, "
    "Channel = first(Channel) OVER (ORDER BY efficiency DESC NULLS LAST, channel_order "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS is_best FROM ("
    + " UNION ALL ".join(
        f"SELECT {i} AS channel_order, '{ch}' AS Channel, CASE WHEN {s} = 0 THEN NULL ELSE {p} / {s} END AS efficiency FROM m"
        for i, (ch, s, r, p) in enumerate(CH)) + ") e",
    "m AS (SELECT " + ", ".join(f"avg({s}) AS {s}, avg({p}) AS {p}" for _, s, _r, p in CH) + " FROM t)"))
def a12_channel_efficiency(spark, sf_dir):
    return report(A.channel_efficiency(_bt(spark, sf_dir)))


# --- A7 -----------------------------------------------------------------------------
@register("a7_best_groups", sql=with_base(" UNION ALL ".join(
    f"SELECT * FROM (SELECT '{c}' AS dimension, {c} AS best, {R6('avg(TotalNetProfit)')} AS mean_value "
    f"FROM t WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY avg(TotalNetProfit) DESC NULLS LAST, {c} LIMIT 1)"
    for c in ["CuisineType", "Segment", "Subregion"])))
def a7_best_groups(spark, sf_dir):
    return report(A.best_groups(_bt(spark, sf_dir)))


# --- A9 / F3 --------------------------------------------------------------------------
_A9_D = "(CASE WHEN hi IS NULL OR lo IS NULL THEN NULL WHEN hi <> 0 THEN (lo - hi) / abs(hi) * 100e0 ELSE 0e0 END)"


@register("a9_commission_impact", sql=with_base(
    f"SELECT {R6('hi')} AS high_comm_profit, {R6('lo')} AS low_comm_profit, {R6(_A9_D)} AS impact_pct, "
    f"CASE WHEN {_A9_D} > 0 THEN 'more' ELSE 'less' END AS direction FROM ("
    "SELECT avg(CASE WHEN CommissionRate > 0.3e0 THEN TotalNetProfit END) AS hi, "
    "avg(CASE WHEN CommissionRate <= 0.3e0 THEN TotalNetProfit END) AS lo FROM t) a"))
def a9_commission_impact(spark, sf_dir):
    return report(A.commission_impact(_bt(spark, sf_dir)))


# --- A10 ------------------------------------------------------------------------------
@register("a10_cost_structure", sql=with_base(
    "SELECT component, " + R6("v * 100e0") + " AS avg_pct_of_revenue FROM ("
    "SELECT 'COGS' AS component, c AS v FROM m UNION ALL SELECT 'OPEX', o FROM m "
    "UNION ALL SELECT 'Commission', k FROM m UNION ALL SELECT 'Delivery Cost', d FROM m) x",
    f"m AS (SELECT avg(COGSRate) AS c, avg(OPEXRate) AS o, avg(CommissionRate) AS k, "
    f"avg({PD_DIV('SD_DeliveryTotalCost', 'TotalRevenue')}) AS d FROM t)"))
def a10_cost_structure(spark, sf_dir):
    return report(A.cost_structure(_bt(spark, sf_dir)))


# --- A14-A16, A19 ---------------------------------------------------------------------
@register("a14_a16_optimisation_kpis", sql=with_base(
    f"SELECT {R6('sd / mr * 100e0')} AS sensitivity_index, {R6('be')} AS breakeven_commission, "
    f"{R6('(p75 - mp) / abs(mp) * 100e0')} AS uplift_pct FROM ("
    "SELECT stddev_samp(TotalNetProfit) AS sd, avg(TotalRevenue) AS mr, "
    "max(CASE WHEN UberEatsNetProfit > 0 THEN CommissionRate END) AS be, avg(TotalNetProfit) AS mp, "
    "quantile_cont(TotalNetProfit, 0.75) AS p75 FROM t) a"))
def a14_a16_optimisation_kpis(spark, sf_dir):
    return report(A.optimisation_kpis(_bt(spark, sf_dir)))


@register("a19_self_delivery_thresholds", sql=with_base(
    "SELECT " + R6("max(CASE WHEN SelfDeliveryNetProfit > 0 THEN DeliveryCostPerOrder END)") + " AS max_profitable_cost, "
    "max(CASE WHEN SelfDeliveryNetProfit > 0 THEN DeliveryRadiusKM END) AS max_profitable_radius, "
    + R6("avg(CASE WHEN COALESCE(SelfDeliveryNetProfit > 0, false) THEN 1e0 ELSE 0e0 END) * 100e0")
    + " AS profitable_pct FROM t"))
def a19_self_delivery_thresholds(spark, sf_dir):
    return report(A.self_delivery_thresholds(_bt(spark, sf_dir)))


# --- A17, A18 (B1 buckets) ---------------------------------------------------------------
@register("a17_commission_bucket_stats", sql=with_base(
    f"SELECT b AS CommBucket, bi AS CommBucket_idx, CAST(count(*) AS BIGINT) AS n, {R6('avg(TotalNetProfit)')} AS mean, "
    f"{R6('quantile_cont(TotalNetProfit, 0.5)')} AS median, {R6('stddev_samp(TotalNetProfit)')} AS std "
    "FROM bt WHERE b IS NOT NULL GROUP BY b, bi",
    f"bt AS (SELECT *, {COMM_BUCKET} AS b, {COMM_BUCKET_IDX} AS bi FROM t)"))
def a17_commission_bucket_stats(spark, sf_dir):
    return report(A.bucket_stats(_bt(spark, sf_dir)))


@register("a18_bucket_profitable_pct", sql=with_base(
    "SELECT b AS CommBucket, bi AS CommBucket_idx, "
    + R6("avg(CASE WHEN COALESCE(UberEatsNetProfit > 0, false) THEN 1e0 ELSE 0e0 END) * 100e0")
    + " AS profitable_pct FROM bt WHERE b IS NOT NULL GROUP BY b, bi",
    f"bt AS (SELECT *, {COMM_BUCKET} AS b, {COMM_BUCKET_IDX} AS bi FROM t)"))
def a18_bucket_profitable_pct(spark, sf_dir):
    return report(A.bucket_profitable_pct(_bt(spark, sf_dir)))


# --- A20, R2, A21 (B2 equal-width bins) ------------------------------------------------------
_GRID_CTES = [
    EDGES_CTE("ce", "t", "DeliveryCostPerOrder", 5), EDGES_CTE("re", "t", "DeliveryRadiusKM", 5),
    f"g0 AS (SELECT t.*, {BIN_IDX('DeliveryCostPerOrder', 'ce', 5)} AS CostBin, "
    f"{BIN_IDX('DeliveryRadiusKM', 're', 5)} AS RadiusBin FROM t, ce, re)",
    f"g AS (SELECT g0.*, {BIN_EDGE('ce', 'CostBin', 5, False)} AS CostBin_lo, {BIN_EDGE('ce', 'CostBin', 5, True)} AS CostBin_hi, "
    f"{BIN_EDGE('re', 'RadiusBin', 5, False)} AS RadiusBin_lo, {BIN_EDGE('re', 'RadiusBin', 5, True)} AS RadiusBin_hi "
    "FROM g0, ce, re)",
]


@register("a20_cost_radius_grid", sql=with_base(
    f"SELECT CostBin, {R6('CostBin_lo')} AS CostBin_lo, {R6('CostBin_hi')} AS CostBin_hi, RadiusBin, "
    f"{R6('RadiusBin_lo')} AS RadiusBin_lo, {R6('RadiusBin_hi')} AS RadiusBin_hi, "
    f"{R6('avg(SelfDeliveryNetProfit)')} AS avg_sd_profit, CAST(count(*) AS BIGINT) AS n FROM g "
    "WHERE CostBin IS NOT NULL AND RadiusBin IS NOT NULL "
    "GROUP BY CostBin, CostBin_lo, CostBin_hi, RadiusBin, RadiusBin_lo, RadiusBin_hi", *_GRID_CTES))
def a20_cost_radius_grid(spark, sf_dir):
    g = A.cost_radius_grid(_bt(spark, sf_dir))
    return report(g)


@register("r2_cost_radius_pivot", sql=with_base(
    f"SELECT CostBin, {R6('CostBin_lo')} AS CostBin_lo, {R6('CostBin_hi')} AS CostBin_hi, "
    + ", ".join(f"{R6(f'avg(CASE WHEN RadiusBin = {i} THEN SelfDeliveryNetProfit END)')} AS radius_bin_{i}"
                for i in range(1, 6))
    + " FROM g WHERE CostBin IS NOT NULL AND RadiusBin IS NOT NULL GROUP BY CostBin, CostBin_lo, CostBin_hi",
    *_GRID_CTES))
def r2_cost_radius_pivot(spark, sf_dir):
    return report(A.cost_radius_pivot(_bt(spark, sf_dir)))


def _share_bin_sql2(share, e):
    return (f"SELECT * FROM (SELECT '{share}' AS share, sb AS bin, {R6('lo')} AS bin_lo, {R6('hi')} AS bin_hi, "
            f"{R6('avg(TotalNetProfit)')} AS mean_value FROM ("
            f"SELECT t.TotalNetProfit, {BIN_IDX(share, e, 5)} AS sb, "
            f"{BIN_EDGE(e, BIN_IDX(share, e, 5), 5, False)} AS lo, {BIN_EDGE(e, BIN_IDX(share, e, 5), 5, True)} AS hi "
            f"FROM t, {e}) x WHERE sb IS NOT NULL GROUP BY sb, lo, hi "
            "ORDER BY avg(TotalNetProfit) DESC NULLS LAST, sb LIMIT 1)")


@register("a21_best_share_bins", sql=with_base(
    _share_bin_sql2("InStoreShare", "e_is") + " UNION ALL " + _share_bin_sql2("SD_share", "e_sd"),
    EDGES_CTE("e_is", "t", "InStoreShare", 5), EDGES_CTE("e_sd", "t", "SD_share", 5)))
def a21_best_share_bins(spark, sf_dir):
    t = _bt(spark, sf_dir)
    return report(A.best_share_bin(t, "InStoreShare").unionByName(A.best_share_bin(t, "SD_share")))


# --- A22 ------------------------------------------------------------------------------------
def _corr_sql():
    from ..schema import CORR_COLS
    pairs = [(a, b) for i, a in enumerate(CORR_COLS) for b in CORR_COLS[i + 1:]]
    aggs = ", ".join(f"{CORR(a, b)} AS r{i}" for i, (a, b) in enumerate(pairs))
    rows = " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, {R6(f'r{i}')} AS r FROM m"
                              for i, (a, b) in enumerate(pairs))
    return with_base(rows, f"m AS (SELECT {aggs} FROM t)")


@register("a22_correlation_matrix", sql=_corr_sql())
def a22_correlation_matrix(spark, sf_dir):
    return report(A.correlation_matrix(_bt(spark, sf_dir)))


# --- A23 ------------------------------------------------------------------------------------
@register("a23_share_bounds", sql=with_base(" UNION ALL ".join(
    f"SELECT {i} AS share_order, '{c}' AS share, {R6(f'quantile_cont({c}, 0.1)')} AS p_lo, "
    f"{R6(f'quantile_cont({c}, 0.9)')} AS p_hi, {R6(f'avg({c})')} AS mean, "
    f"{R6(f'avg({c}) / (SELECT ' + ' + '.join(f'avg({s})' for s in SHARE_COLS) + ' FROM t)')} AS mean_normalised "
    "FROM t" for i, c in enumerate(SHARE_COLS))))
def a23_share_bounds(spark, sf_dir):
    return report(A.share_bounds(_bt(spark, sf_dir)))


# --- A24 ------------------------------------------------------------------------------------
@register("a24_category_domains", sql=with_base(" UNION ALL ".join(
    f"SELECT '{c}' AS category, value, CAST(dense_rank() OVER (ORDER BY value) - 1 AS INT) AS code "
    f"FROM (SELECT DISTINCT {c} AS value FROM t WHERE {c} IS NOT NULL) d{i}"
    for i, c in enumerate(["CuisineType", "Segment", "Subregion"]))))
def a24_category_domains(spark, sf_dir):
    """Sorted distinct domain of each category with its 0-based code: one
    distinct over the unpivoted categories and a range-partitioned rank."""
    from ..ml.prepare import code_tables_for
    return code_tables_for(_bt(spark, sf_dir), ["CuisineType", "Segment", "Subregion"])


# --- R1, R3 -----------------------------------------------------------------------------------
@register("r1_cuisine_segment_pivot", sql=with_base(
    "SELECT CuisineType, " + ", ".join(
        f"{R6(f'avg(CASE WHEN Segment = {chr(39)}{s}{chr(39)} THEN TotalNetProfit END)')} AS {s}"
        for s in ["Casual", "Fast", "Fine", "Ghost"])
    + " FROM t WHERE CuisineType IS NOT NULL AND Segment IS NOT NULL GROUP BY CuisineType"))
def r1_cuisine_segment_pivot(spark, sf_dir):
    return report(A.cuisine_segment_pivot(_bt(spark, sf_dir)))


@register("r3_channels_long", sql=with_base(" UNION ALL ".join(
    f"SELECT {KEY}, {i} AS channel_order, '{ch}' AS Channel, {R6(r)} AS Revenue, {R6(p)} AS NetProfit, "
    f"{R6(f'CASE WHEN {r} <> 0 THEN {p} / {r} ELSE 0e0 END')} AS Margin FROM t"
    for i, (ch, _s, r, p) in enumerate(CH))))
def r3_channels_long(spark, sf_dir):
    return report(A.channels_long(_bt(spark, sf_dir), KEY_COLS))


# --- T1, T2 -------------------------------------------------------------------------------------
@register("t1_top20_profit", sql=with_base(
    f"SELECT {KEY}, RestaurantName, CuisineType, Segment, Subregion, {R6('InStoreShare')} AS InStoreShare, "
    f"{R6('UE_share')} AS UE_share, {R6('SD_share')} AS SD_share, {R6('CommissionRate')} AS CommissionRate, "
    f"{R6('TotalNetProfit')} AS TotalNetProfit, {R6('OverallMargin')} AS OverallMargin FROM t "
    f"ORDER BY TotalNetProfit DESC NULLS LAST, {KEY} LIMIT 20"))
def t1_top20_profit(spark, sf_dir):
    return report(ranking.top_profit(_bt(spark, sf_dir), 20, formatted=False))


_SCORE = ("(TotalNetProfit / mx_p) * 40e0 + (1e0 - CommissionRate / mx_c) * 30e0 "
          "+ InStoreShare * 20e0 + (GrowthFactor / mx_g) * 10e0")


@register("t2_optimisation_score_top15", sql=with_base(
    f"SELECT {KEY}, RestaurantName, CuisineType, Segment, Subregion, OptScore, "
    f"{R6('TotalNetProfit')} AS TotalNetProfit, {R6('CommissionRate')} AS CommissionRate FROM ("
    f"SELECT t.*, {RN(_SCORE, 2)} AS OptScore FROM t, "
    "(SELECT max(TotalNetProfit) AS mx_p, max(CommissionRate) AS mx_c, max(GrowthFactor) AS mx_g FROM t) mx) s "
    f"ORDER BY OptScore DESC NULLS LAST, {KEY} LIMIT 15"))
def t2_optimisation_score_top15(spark, sf_dir):
    return report(ranking.top_score(_bt(spark, sf_dir), 15, formatted=False))


# --- X3 display formats of T1 / T2 -----------------------------------------------------
def _fmt_pct(x, d):
    if d == 0:
        return f"format('{{:,.0f}}', {RN(x + ' * 100e0', 0)}) || '%'"
    return f"format('{{:,.{d}f}}', {RN(x + ' * 100e0', d)}) || '%'"


def _fmt_money(x):
    return f"'$' || format('{{:,.0f}}', {RN(x, 0)})"


@register("t1_top20_profit_formatted", sql=with_base(
    f"SELECT {KEY}, RestaurantName, CuisineType, Segment, Subregion, {_fmt_pct('InStoreShare', 0)} AS InStoreShare, "
    f"{_fmt_pct('UE_share', 0)} AS UE_share, {_fmt_pct('SD_share', 0)} AS SD_share, "
    f"{_fmt_pct('CommissionRate', 1)} AS CommissionRate, {_fmt_money('TotalNetProfit')} AS TotalNetProfit, "
    f"{_fmt_pct('OverallMargin', 1)} AS OverallMargin FROM t ORDER BY t.TotalNetProfit DESC NULLS LAST, {KEY} LIMIT 20"))
def t1_top20_profit_formatted(spark, sf_dir):
    return ranking.top_profit(_bt(spark, sf_dir), 20, formatted=True)


@register("t2_optimisation_score_top15_formatted", sql=with_base(
    f"SELECT {KEY}, RestaurantName, CuisineType, Segment, Subregion, OptScore, "
    "format('{:,.2f}', OptScore) AS OptScoreText, "
    f"{_fmt_money('TotalNetProfit')} AS TotalNetProfitText, {_fmt_pct('CommissionRate', 1)} AS CommissionRateText FROM ("
    f"SELECT t.*, {RN(_SCORE, 2)} AS OptScore FROM t, "
    "(SELECT max(TotalNetProfit) AS mx_p, max(CommissionRate) AS mx_c, max(GrowthFactor) AS mx_g FROM t) mx) s "
    f"ORDER BY OptScore DESC NULLS LAST, {KEY} LIMIT 15"))
def t2_optimisation_score_top15_formatted(spark, sf_dir):
    return ranking.top_score(_bt(spark, sf_dir), 15, formatted=True)


# --- B1, B2 row level ---------------------------------------------------------------------
@register("b1_commission_buckets", sql=with_base(
    f"SELECT {KEY}, {R6('CommissionRate')} AS CommissionRate, {COMM_BUCKET} AS CommBucket FROM t"))
def b1_commission_buckets(spark, sf_dir):
    from ..functions.binning import commission_bucket
    b = commission_bucket(_bt(spark, sf_dir))
    return report(b.select(*KEY_COLS, "CommissionRate", "CommBucket"))


@register("b2_equal_width_bins", sql=with_base(
    f"SELECT {KEY}, CostBin, {R6('CostBin_lo')} AS CostBin_lo, {R6('CostBin_hi')} AS CostBin_hi, RadiusBin, "
    f"{R6('RadiusBin_lo')} AS RadiusBin_lo, {R6('RadiusBin_hi')} AS RadiusBin_hi FROM g", *_GRID_CTES))
def b2_equal_width_bins(spark, sf_dir):
    from ..functions.binning import assign_bins
    b = assign_bins(_bt(spark, sf_dir), "DeliveryCostPerOrder", 5, "CostBin")
    b = assign_bins(b, "DeliveryRadiusKM", 5, "RadiusBin")
    return report(b.select(*KEY_COLS, "CostBin", "CostBin_lo", "CostBin_hi", "RadiusBin", "RadiusBin_lo",
                           "RadiusBin_hi"))
