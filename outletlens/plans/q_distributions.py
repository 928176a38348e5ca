"""Registered queries for the chart data (B3-B8) with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import distributions as D
from .catalog import base_table, register, report
from ..functions.compat import round_even
from .sqlbase import BIN_EDGE, BIN_IDX, COMM_BUCKET, EDGES_CTE, R6, RN, with_base


def _bt(spark, sf_dir):
    return base_table(spark, sf_dir)


# --- B3 ----------------------------------------------------------------------------
def _hist_sql(col, bins):
    return with_base(
        f"SELECT CAST(i AS INT) AS bin, {R6(BIN_EDGE('he', 'i', bins, False))} AS lo, {R6(BIN_EDGE('he', 'i', bins, True))} AS hi, "
        "CAST(COALESCE(c.cnt, 0) AS BIGINT) AS count "
        f"FROM he, (SELECT unnest(range(1, {bins + 1})) AS i) ii LEFT JOIN "
        f"(SELECT {BIN_IDX(col, 'he', bins)} AS b, count(*) AS cnt FROM t, he WHERE {col} IS NOT NULL GROUP BY 1) c "
        "ON c.b = ii.i",
        EDGES_CTE("he", "t", col, bins))


@register("b3_profit_histogram", sql=_hist_sql("TotalNetProfit", 50))
def b3_profit_histogram(spark, sf_dir):
    return report(D.histogram(_bt(spark, sf_dir), "TotalNetProfit", 50))


_NICE_CTES = [
    "mm AS (SELECT min(TotalNetProfit) AS mn, max(TotalNetProfit) AS mx FROM t)",
    "tn AS (SELECT *, (mx - mn) / 50e0 AS raw, pow(10e0, floor(log10((mx - mn) / 50e0))) AS ten FROM mm)",
    # every nice width from one power of ten below to two above; the narrowest that gives at most 50 aligned bins
    "ws AS (SELECT f * ten AS w, mn, mx FROM tn, (SELECT unnest([1e0, 2e0, 5e0, 10e0, 20e0]) AS f) fs WHERE f * ten >= raw)",
    "ne AS (SELECT w, floor(mn / w) AS first, CAST(floor(mx / w) - floor(mn / w) + 1 AS INT) AS n FROM ws "
    "WHERE floor(mx / w) - floor(mn / w) + 1 <= 50 ORDER BY w LIMIT 1)"]


@register("b3_nice_profit_histogram", sql=with_base(
    f"SELECT CAST(i AS INT) AS bin, {R6('(first + i - 1) * w')} AS lo, {R6('(first + i) * w')} AS hi, "
    "CAST(COALESCE(c.cnt, 0) AS BIGINT) AS count FROM (SELECT ne.*, unnest(range(1, n + 1)) AS i FROM ne) x LEFT JOIN "
    "(SELECT floor(TotalNetProfit / w) - first + 1 AS b, count(*) AS cnt FROM t, ne WHERE TotalNetProfit IS NOT NULL GROUP BY 1) c "
    "ON c.b = x.i", *_NICE_CTES))
def b3_nice_profit_histogram(spark, sf_dir):
    return report(D.nice_histogram(_bt(spark, sf_dir), "TotalNetProfit", 50))


# --- B4 ----------------------------------------------------------------------------
def _box_sql(col, by_expr, by_name, src="t"):
    return with_base(
        f"SELECT d.g AS {by_name}, {R6('q1')} AS q1, {R6('median')} AS median, {R6('q3')} AS q3, "
        "CAST(count(*) AS BIGINT) AS n, "
        f"{R6('min(CASE WHEN v >= q1 - 1.5e0 * (q3 - q1) AND v <= q3 + 1.5e0 * (q3 - q1) THEN v END)')} AS whisker_lo, "
        f"{R6('max(CASE WHEN v >= q1 - 1.5e0 * (q3 - q1) AND v <= q3 + 1.5e0 * (q3 - q1) THEN v END)')} AS whisker_hi, "
        "CAST(sum(CASE WHEN v >= q1 - 1.5e0 * (q3 - q1) AND v <= q3 + 1.5e0 * (q3 - q1) THEN 0 ELSE 1 END) AS BIGINT) AS n_outside "
        "FROM d JOIN (SELECT g, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, "
        "quantile_cont(v, 0.75) AS q3 FROM d GROUP BY g) q ON q.g = d.g GROUP BY d.g, q1, median, q3",
        f"d AS (SELECT {by_expr} AS g, CAST({col} AS DOUBLE) AS v FROM {src} "
        f"WHERE {by_expr} IS NOT NULL AND {col} IS NOT NULL)")


@register("b4_box_profit_by_cuisine", sql=_box_sql("TotalNetProfit", "CuisineType", "CuisineType"))
def b4_box_profit_by_cuisine(spark, sf_dir):
    return report(D.box_stats(_bt(spark, sf_dir), "TotalNetProfit", "CuisineType"))


def _bucket_box(col):
    def q(spark, sf_dir):
        from ..functions.binning import commission_bucket
        b = commission_bucket(_bt(spark, sf_dir))
        return report(D.box_stats(b, col, "CommBucket"))
    return q


register("b4_box_ue_profit_by_bucket", sql=_box_sql("UberEatsNetProfit", COMM_BUCKET, "CommBucket"))(
    _bucket_box("UberEatsNetProfit"))
register("b4_box_dd_profit_by_bucket", sql=_box_sql("DoorDashNetProfit", COMM_BUCKET, "CommBucket"))(
    _bucket_box("DoorDashNetProfit"))


# --- B5 ----------------------------------------------------------------------------
_KDE_CTES = [
    "d AS (SELECT Segment AS g, CAST(OverallMargin AS DOUBLE) AS v FROM t "
    "WHERE Segment IS NOT NULL AND OverallMargin IS NOT NULL AND NOT isnan(OverallMargin))",
    "st0 AS (SELECT g, count(*) AS n, stddev_samp(v) AS sd, min(v) AS mn, max(v) AS mx, "
    "quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM d GROUP BY g)",
    "st AS (SELECT g, n, mn, mx, 1.059e0 * least(sd, (q3 - q1) / 1.349e0) * pow(CAST(n AS DOUBLE), -0.2e0) AS bw, "
    "(mx - mn) / 512e0 AS w FROM st0)",
    "binned AS (SELECT d.g, CAST(CASE WHEN w > 0 THEN least(floor((v - mn) / w), 511) ELSE 0 END AS INT) AS fb, "
    "count(*) AS c FROM d JOIN st ON st.g = d.g GROUP BY 1, 2)",
    "pts AS (SELECT g, n, bw, mn, mx, w, gi, mn + (mx - mn) * CAST(gi AS DOUBLE) / 49e0 AS x "
    "FROM st, (SELECT unnest(range(0, 50)) AS gi) r)",
]


def _kde_sql(*ctes):
    return with_base(
    f"SELECT pts.g AS Segment, CAST(gi AS INT) AS gi, {R6('x')} AS x, {R6('bw')} AS bw, "
    + R6("sum(CAST(c AS DOUBLE) * exp(-0.5e0 * ((x - (mn + (CAST(fb AS DOUBLE) + 0.5e0) * w)) / bw) "
         "* ((x - (mn + (CAST(fb AS DOUBLE) + 0.5e0) * w)) / bw))) / (CAST(n AS DOUBLE) * bw * sqrt(2e0 * pi()))")
    + " AS density FROM pts JOIN binned ON binned.g = pts.g GROUP BY pts.g, gi, x, n, bw",
    *ctes)


@register("b5_violin_margin_by_segment", sql=_kde_sql(*_KDE_CTES))
def b5_violin_margin_by_segment(spark, sf_dir):
    return report(D.violin_density(_bt(spark, sf_dir), "OverallMargin", "Segment"))


_SOFT = _KDE_CTES[-1].replace("mn + (mx - mn) *", "mn - 2e0 * bw + (mx + 2e0 * bw - (mn - 2e0 * bw)) *")


@register("b5_violin_margin_soft_span", sql=_kde_sql(*_KDE_CTES[:-1], _SOFT))
def b5_violin_margin_soft_span(spark, sf_dir):
    return report(D.violin_density(_bt(spark, sf_dir), "OverallMargin", "Segment", reach=2.0))


@register("b5_violin_box_by_segment", sql=_box_sql("OverallMargin", "Segment", "Segment"))
def b5_violin_box_by_segment(spark, sf_dir):
    return report(D.box_stats(_bt(spark, sf_dir), "OverallMargin", "Segment"))


# --- B6, B8 --------------------------------------------------------------------------
def _nan_null(e):
    return f"(CASE WHEN isnan({e}) THEN NULL ELSE {e} END)"


def _trend_sql(sites, extra=""):
    parts = []
    for i, (x, y, by) in sites:
        parts.append(
            f"SELECT {i} AS site, '{x}' AS x, '{y}' AS y, '{by}' AS group_col, {by} AS \"group\", "
            f"{R6(_nan_null(f'regr_slope({y}, {x})'))} AS slope, {R6(_nan_null(f'regr_intercept({y}, {x})'))} AS intercept, "
            f"{R6(_nan_null(f'regr_r2({y}, {x})'))} AS r2, CAST(regr_count({y}, {x}) AS BIGINT) AS n{extra.format(x=x, y=y)} "
            f"FROM t WHERE {by} IS NOT NULL GROUP BY {by}")
    return with_base(" UNION ALL ".join(parts))


@register("b6_trend_lines", sql=_trend_sql(list(enumerate(D.TREND_SITES))))
def b6_trend_lines(spark, sf_dir):
    return report(D.all_trend_lines(_bt(spark, sf_dir)))


_BE = (", " + R6("CASE WHEN regr_slope({y}, {x}) = 0 OR isnan(regr_slope({y}, {x})) THEN NULL "
                 "ELSE -regr_intercept({y}, {x}) / regr_slope({y}, {x}) END") + " AS break_even_x")


@register("b8_break_even_lines", sql=_trend_sql([(i, D.TREND_SITES[i]) for i in D.BREAK_EVEN_SITES], _BE))
def b8_break_even_lines(spark, sf_dir):
    sites = [D.TREND_SITES[i] for i in D.BREAK_EVEN_SITES]
    t = D.all_trend_lines(_bt(spark, sf_dir), sites)
    # renumber to the global site ids
    t = t.withColumn("site", F.element_at(F.array(*[F.lit(i) for i in D.BREAK_EVEN_SITES]), F.col("site") + 1))
    return report(D.break_even_x(t))


# --- B7 --------------------------------------------------------------------------------
@register("b7_scatter_orders_profit", sql=with_base(
    f"SELECT Segment, xb, {R6('xb_lo')} AS xb_lo, {R6('xb_hi')} AS xb_hi, yb, {R6('yb_lo')} AS yb_lo, "
    f"{R6('yb_hi')} AS yb_hi, CAST(count(*) AS BIGINT) AS n, {R6(RN('avg(AOV)', 4))} AS mean_size FROM ("
    f"SELECT Segment, AOV, {BIN_IDX('MonthlyOrders', 'xe', 50)} AS xb, {BIN_IDX('TotalNetProfit', 'ye', 50)} AS yb, "
    f"{BIN_EDGE('xe', BIN_IDX('MonthlyOrders', 'xe', 50), 50, False)} AS xb_lo, "
    f"{BIN_EDGE('xe', BIN_IDX('MonthlyOrders', 'xe', 50), 50, True)} AS xb_hi, "
    f"{BIN_EDGE('ye', BIN_IDX('TotalNetProfit', 'ye', 50), 50, False)} AS yb_lo, "
    f"{BIN_EDGE('ye', BIN_IDX('TotalNetProfit', 'ye', 50), 50, True)} AS yb_hi FROM t, xe, ye) s "
    "WHERE xb IS NOT NULL AND yb IS NOT NULL AND Segment IS NOT NULL "
    "GROUP BY Segment, xb, xb_lo, xb_hi, yb, yb_lo, yb_hi",
    EDGES_CTE("xe", "t", "MonthlyOrders", 50), EDGES_CTE("ye", "t", "TotalNetProfit", 50)))
def b7_scatter_orders_profit(spark, sf_dir):
    s = D.scatter_bins(_bt(spark, sf_dir), "MonthlyOrders", "TotalNetProfit", "Segment", "AOV")
    # few rows per cell: a 4-decimal mean keeps engine summation order out of the check
    return report(s.withColumn("mean_size", round_even("mean_size", 4)))


@register("b7_scatter_cogs_opex", sql=with_base(
    f"SELECT xb, {R6('xb_lo')} AS xb_lo, {R6('xb_hi')} AS xb_hi, yb, {R6('yb_lo')} AS yb_lo, "
    f"{R6('yb_hi')} AS yb_hi, CAST(count(*) AS BIGINT) AS n, {R6(RN('avg(TotalNetProfit)', 4))} AS mean_color FROM ("
    f"SELECT TotalNetProfit, {BIN_IDX('COGSRate', 'xe', 50)} AS xb, {BIN_IDX('OPEXRate', 'ye', 50)} AS yb, "
    f"{BIN_EDGE('xe', BIN_IDX('COGSRate', 'xe', 50), 50, False)} AS xb_lo, "
    f"{BIN_EDGE('xe', BIN_IDX('COGSRate', 'xe', 50), 50, True)} AS xb_hi, "
    f"{BIN_EDGE('ye', BIN_IDX('OPEXRate', 'ye', 50), 50, False)} AS yb_lo, "
    f"{BIN_EDGE('ye', BIN_IDX('OPEXRate', 'ye', 50), 50, True)} AS yb_hi FROM t, xe, ye) s "
    "WHERE xb IS NOT NULL AND yb IS NOT NULL GROUP BY xb, xb_lo, xb_hi, yb, yb_lo, yb_hi",
    EDGES_CTE("xe", "t", "COGSRate", 50), EDGES_CTE("ye", "t", "OPEXRate", 50)))
def b7_scatter_cogs_opex(spark, sf_dir):
    s = D.scatter_bins(_bt(spark, sf_dir), "COGSRate", "OPEXRate", mean_color="TotalNetProfit")
    return report(s.withColumn("mean_color", round_even("mean_color", 4)))
