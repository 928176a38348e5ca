"""Group, channel and table-wide aggregates (A1-A25, F3, F4) and reshapes.

Plan shape: every operator here is one algebraic aggregate (or a handful
combined into one ``agg``) over the analysis table, so Spark runs a partial
aggregate in every scan task and shuffles at most one row per group per
task. Grouping keys are the small category domains (cuisine, segment,
subregion, bucket, bin); a hot key only makes its map-side partial bigger,
never one reducer's input. Wide -> long reshapes use ``stack`` on the one
aggregated row (no shuffle). Exact percentiles go through
:func:`exact_quantiles`, which splits hot groups across range partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binning import assign_bins, commission_bucket
from ..functions.compat import pd_div
from ..functions.quantiles import exact_quantiles
from ..schema import (CATEGORY_COLS, CHANNELS, COMMISSION_EDGES, COMMISSION_SPLIT, CORR_COLS, PROFIT_COLS,
                      REVENUE_COLS, SHARE_COLS)


def _stack(df: DataFrame, name_col: str, pairs, value_cols) -> DataFrame:
    """Wide -> long on a (small) frame: ``pairs`` = [(label, [exprs...]), ...]."""
    structs = [F.struct(F.lit(label).alias(name_col),
                        *[e.alias(v) for e, v in zip(exprs, value_cols)])
               for label, exprs in pairs]
    return df.select(F.inline(F.array(*structs)))


def _ordinal(labels, name_col: str, out: str):
    expr = None
    for i, lab in enumerate(labels):
        cond = F.col(name_col) == F.lit(lab)
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr.alias(out)


# --- A1, A2 -------------------------------------------------------------------
def kpi_summary(df: DataFrame) -> DataFrame:
    """A1: distinct restaurants and four table means (one aggregate)."""
    return df.agg(
        F.count_distinct("RestaurantID").alias("n_restaurants"),
        F.avg("MonthlyOrders").alias("avg_orders"),
        F.avg("TotalNetProfit").alias("avg_profit"),
        (F.avg("OverallMargin") * 100.0).alias("avg_margin_pct"),
        (F.avg("CommissionRate") * 100.0).alias("avg_commission_pct"),
    )


def outlier_summary(df: DataFrame) -> DataFrame:
    """A2: outlier count and percentage of all rows."""
    return df.agg(
        F.count_if(F.col("IsOutlier")).alias("n_outliers"),
        F.count(F.lit(1)).alias("n_rows"),
        (F.avg(F.col("IsOutlier").cast("double")) * 100.0).alias("outlier_pct"),
    )


# --- A3, A4, A6, A11, A24 ----------------------------------------------------
def group_means(df: DataFrame, by, cols) -> DataFrame:
    """Mean of ``cols`` per group; NULL keys are dropped (pandas groupby)."""
    by = [by] if isinstance(by, str) else list(by)
    cols = [cols] if isinstance(cols, str) else list(cols)
    keep = F.lit(True)
    for b in by:
        keep = keep & F.col(b).isNotNull()
    return (df.where(keep).groupBy(*by)
            .agg(*[F.avg(c).alias(f"avg_{c}") for c in cols]))


def category_domain(df: DataFrame, col: str) -> DataFrame:
    """Sorted distinct values of a category (value, 0-based code), ranked
    with a range shuffle (no single-task window)."""
    from ..ml.prepare import code_tables_for
    return code_tables_for(df, [col]).select("value", "code")


# --- A5, A8, A12, A13 (channel means, wide -> long) ---------------------------
def channel_means(df: DataFrame) -> DataFrame:
    """A13 (+A5): per channel mean share, revenue and profit, in channel order."""
    row = df.agg(*[F.avg(c).alias(c) for c in SHARE_COLS + REVENUE_COLS + PROFIT_COLS])
    pairs = [(ch, [F.col(s), F.col(r), F.col(p)])
             for ch, s, r, p in zip(CHANNELS, SHARE_COLS, REVENUE_COLS, PROFIT_COLS)]
    long = _stack(row, "Channel", pairs, ["avg_share", "avg_revenue", "avg_profit"])
    return long.select(_ordinal(CHANNELS, "Channel", "channel_order"), "*")


def channel_mix(df: DataFrame) -> DataFrame:
    """A5: average channel mix (long)."""
    return channel_means(df).select("channel_order", "Channel", "avg_share")


def best_channel(df: DataFrame) -> DataFrame:
    """Channel with the highest mean net profit; ties -> channel order."""
    return (channel_means(df).orderBy(F.col("avg_profit").desc_nulls_last(),
                                      F.col("channel_order").asc())
            .limit(1).select("Channel", "avg_profit"))


def channel_efficiency(df: DataFrame) -> DataFrame:
    """Mean profit / mean share per channel (ratio of means) + best flag."""
    c = channel_means(df)
    eff = c.select("channel_order", "Channel",
                   F.try_divide(F.col("avg_profit"), F.col("avg_share")).alias("efficiency"))
    best = (eff.orderBy(F.col("efficiency").desc_nulls_last(), F.col("channel_order").asc())
            .limit(1).select(F.col("Channel").alias("_best")))
    return (eff.join(F.broadcast(best), F.lit(True), "left")   # 1 row
            .select("channel_order", "Channel", "efficiency",
                    (F.col("Channel") == F.col("_best")).alias("is_best")))


# --- A7 -----------------------------------------------------------------------
def best_groups(df: DataFrame, col: str = "TotalNetProfit", cols=CATEGORY_COLS) -> DataFrame:
    """A7 for several categories in one scan: ``groupingSets`` gives every
    category's group means from one Expand + aggregate; the argmax per
    category is a window over those few rows (ties -> smallest key)."""
    g = df.groupingSets([[c] for c in cols], *cols).agg(
        F.avg(col).alias("_m"), *[F.grouping(c).alias(f"_g_{c}") for c in cols])
    rows = [F.when((F.col(f"_g_{c}") == 0) & F.col(c).isNotNull(),
                   F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("best"),
                            F.col("_m").alias("mean_value"))) for c in cols]
    long = g.select(F.inline(F.filter(F.array(*rows), lambda e: e.isNotNull())))
    w = Window.partitionBy("dimension").orderBy(F.col("mean_value").desc_nulls_last(), F.col("best").asc())
    return long.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


# --- A9 / F3 -------------------------------------------------------------------
def commission_impact(df: DataFrame, split: float = COMMISSION_SPLIT) -> DataFrame:
    """Low vs high commission mean profit, one pass with conditional means."""
    comm, p = F.col("CommissionRate"), F.col("TotalNetProfit")
    row = df.agg(F.avg(F.when(comm > split, p)).alias("high_comm_profit"),
                 F.avg(F.when(comm <= split, p)).alias("low_comm_profit"))
    hi, lo = F.col("high_comm_profit"), F.col("low_comm_profit")
    # a side without rows has no mean: the impact is then unknown (NULL), not 0 %
    delta = F.when(hi.isNull() | lo.isNull(), F.lit(None).cast("double")).when(
        hi != 0, (lo - hi) / F.abs(hi) * 100.0).otherwise(F.lit(0.0))
    return row.select("high_comm_profit", "low_comm_profit", delta.alias("impact_pct"),
                      F.when(delta > 0, F.lit("more")).otherwise(F.lit("less")).alias("direction"))


# --- A10 ------------------------------------------------------------------------
def cost_structure(df: DataFrame) -> DataFrame:
    """A10: mean cost components as % of revenue (long, 4 rows)."""
    row = df.agg(F.avg("COGSRate").alias("c"), F.avg("OPEXRate").alias("o"),
                 F.avg("CommissionRate").alias("m"),
                 F.avg(pd_div("SD_DeliveryTotalCost", "TotalRevenue")).alias("d"))
    pairs = [("COGS", [F.col("c") * 100.0]), ("OPEX", [F.col("o") * 100.0]),
             ("Commission", [F.col("m") * 100.0]), ("Delivery Cost", [F.col("d") * 100.0])]
    return _stack(row, "component", pairs, ["avg_pct_of_revenue"])


# --- A14, A15, A16, A19 (optimisation KPIs) -------------------------------------
def optimisation_kpis(df: DataFrame) -> DataFrame:
    """A14 sensitivity index, A15 break-even commission (F4), A16 uplift potential."""
    q = exact_quantiles(df, "TotalNetProfit", {"p75": 0.75})
    row = df.agg(
        (pd_div(F.stddev_samp("TotalNetProfit"), F.avg("TotalRevenue")) * 100.0).alias("sensitivity_index"),
        F.max(F.when(F.col("UberEatsNetProfit") > 0, F.col("CommissionRate"))).alias("breakeven_commission"),
        F.avg("TotalNetProfit").alias("_mean"))
    out = row.join(F.broadcast(q), F.lit(True), "left")   # both one row
    return out.select("sensitivity_index", "breakeven_commission",
                      (pd_div(F.col("p75") - F.col("_mean"), F.abs(F.col("_mean"))) * 100.0)
                      .alias("uplift_pct"))


def self_delivery_thresholds(df: DataFrame) -> DataFrame:
    """Max profitable cost and radius; % of rows with SD profit > 0."""
    ok = F.coalesce(F.col("SelfDeliveryNetProfit") > 0, F.lit(False))
    return df.agg(
        F.max(F.when(ok, F.col("DeliveryCostPerOrder"))).alias("max_profitable_cost"),
        F.max(F.when(ok, F.col("DeliveryRadiusKM"))).alias("max_profitable_radius"),
        (F.avg(ok.cast("double")) * 100.0).alias("profitable_pct"))


# --- A17, A18 (commission buckets) -----------------------------------------------
def _in_buckets(df: DataFrame, col: str = "CommissionRate") -> DataFrame:
    """Range predicate equal to 'has a bucket', so it reaches the parquet scan."""
    return df.where((F.col(col) > F.lit(COMMISSION_EDGES[0])) & (F.col(col) <= F.lit(COMMISSION_EDGES[-1])))


def bucket_stats(df: DataFrame, col: str = "TotalNetProfit") -> DataFrame:
    """Mean, median, sample std of ``col`` per commission bucket."""
    b = commission_bucket(_in_buckets(df)).where(F.col("CommBucket").isNotNull())
    agg = b.groupBy("CommBucket", "CommBucket_idx").agg(
        F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"),
        F.count(F.lit(1)).alias("n"))
    med = exact_quantiles(b, col, {"median": 0.5}, by=["CommBucket"], bounded_groups=True)   # 4 buckets
    return agg.join(F.broadcast(med), "CommBucket", "left").select(
        "CommBucket", "CommBucket_idx", "n", "mean", "median", "std")


def bucket_profitable_pct(df: DataFrame, col: str = "UberEatsNetProfit") -> DataFrame:
    """% of rows with ``col`` > 0 per commission bucket (NULL counts as not)."""
    b = commission_bucket(_in_buckets(df)).where(F.col("CommBucket").isNotNull())
    ok = F.coalesce(F.col(col) > 0, F.lit(False)).cast("double")
    return b.groupBy("CommBucket", "CommBucket_idx").agg((F.avg(ok) * 100.0).alias("profitable_pct"))


# --- A20, A21, R2 (equal-width bins) -------------------------------------------
def cost_radius_grid(df: DataFrame, bins: int = 5) -> DataFrame:
    """Mean SD profit per (cost bin, radius bin), long form."""
    b = assign_bins(df, "DeliveryCostPerOrder", bins, "CostBin")
    b = assign_bins(b, "DeliveryRadiusKM", bins, "RadiusBin")
    return (b.where(F.col("CostBin").isNotNull() & F.col("RadiusBin").isNotNull())
            .groupBy("CostBin", "CostBin_lo", "CostBin_hi",
                     "RadiusBin", "RadiusBin_lo", "RadiusBin_hi")
            .agg(F.avg("SelfDeliveryNetProfit").alias("avg_sd_profit"),
                 F.count(F.lit(1)).alias("n")))


def cost_radius_pivot(df: DataFrame, bins: int = 5) -> DataFrame:
    """R2: cost bins as rows, radius bins 1..n as columns (values given -> one job)."""
    g = cost_radius_grid(df, bins)
    return (g.groupBy("CostBin", "CostBin_lo", "CostBin_hi")
            .pivot("RadiusBin", list(range(1, bins + 1)))
            .agg(F.first("avg_sd_profit"))
            .select("CostBin", "CostBin_lo", "CostBin_hi",
                    *[F.col(str(i)).alias(f"radius_bin_{i}") for i in range(1, bins + 1)]))


def best_share_bin(df: DataFrame, share: str, bins: int = 5,
                   col: str = "TotalNetProfit") -> DataFrame:
    """The equal-width share bin with the highest mean ``col``; ties -> lower bin."""
    b = assign_bins(df, share, bins, "ShareBin").where(F.col("ShareBin").isNotNull())
    m = b.groupBy("ShareBin", "ShareBin_lo", "ShareBin_hi").agg(F.avg(col).alias("mean_value"))
    return (m.orderBy(F.col("mean_value").desc_nulls_last(), F.col("ShareBin").asc()).limit(1)
            .select(F.lit(share).alias("share"), F.col("ShareBin").alias("bin"),
                    F.col("ShareBin_lo").alias("bin_lo"), F.col("ShareBin_hi").alias("bin_hi"),
                    "mean_value"))


# --- A22 --------------------------------------------------------------------------
def correlation_matrix(df: DataFrame, cols=CORR_COLS) -> DataFrame:
    """Pearson r for every pair (x before y in list order), pairwise-complete.

    NULL, NaN and infinite values count as missing. Two aggregates, whatever is
    missing: the columns' means and deviations, then one MLlib ``Correlation.corr``
    pass (a distributed Gramian) over each column's standardised value (0 where
    missing), its square and its presence. All of a pair's sums over the rows where
    both are present are products of two of these: ``n = p_x.p_y``, ``sum x = x.p_y``,
    ``sum x^2 = x^2.p_y``, ``sum xy = x.y``. The result is a 3k x 3k matrix (bounded by the
    column count). A pair without rows or with a constant side gives NULL.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation
    k, names = len(cols), [f"_c{i}" for i in range(len(cols))]
    finite = lambda v: F.when(F.abs(v) < F.lit(float("inf")), v)  # noqa: E731  (NaN is above every number)
    d = df.select(*[finite(F.col(c).cast("double")).alias(n) for c, n in zip(cols, names)])
    stats = d.agg(*[F.avg(n).alias(f"m{n}") for n in names], *[F.stddev_pop(n).alias(f"s{n}") for n in names]).first()
    z = {n: F.coalesce((F.col(n) - F.lit(stats[f"m{n}"] or 0.0)) / F.lit(stats[f"s{n}"] or 1.0), F.lit(0.0)) for n in names}
    wide = d.select(*[z[n].alias(f"z{n}") for n in names], *[(z[n] * z[n]).alias(f"q{n}") for n in names],
                    *[F.col(n).isNotNull().cast("double").alias(f"p{n}") for n in names])
    moments = wide.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(wide.columns)],
                       *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(wide.columns)]).first()
    pairs = [(i, j) for i in range(k) for j in range(i + 1, k)]
    rows = [(cols[i], cols[j], None) for i, j in pairs]
    if moments["n"]:
        vec = VectorAssembler(inputCols=wide.columns, outputCol="_v").transform(wide)
        m = Correlation.corr(vec, "_v", "pearson").first()[0].toArray()
        mean = [moments[f"m{i}"] for i in range(3 * k)]
        sd = [moments[f"s{i}"] for i in range(3 * k)]

        def product(a, b):      # mean of the product of two columns; a constant one has no covariance
            return mean[a] * mean[b] + (m[a, b] * sd[a] * sd[b] if sd[a] > 0 and sd[b] > 0 else 0.0)
        rows = [(cols[i], cols[j], _pair_r(product(2 * k + i, 2 * k + j), product(i, 2 * k + j), product(j, 2 * k + i),
                                           product(k + i, 2 * k + j), product(k + j, 2 * k + i), product(i, j))) for i, j in pairs]
    return df.sparkSession.createDataFrame(rows, "x string, y string, r double")


def _pair_r(n, x, y, xx, yy, xy):
    """Pearson r from mean presence, sums and products over the rows where both are present."""
    if n <= 0:
        return None
    vx, vy = xx / n - (x / n) ** 2, yy / n - (y / n) ** 2
    return None if min(vx, vy) <= 1e-12 else float((xy / n - x * y / n ** 2) / (vx * vy) ** 0.5)


# --- A23 --------------------------------------------------------------------------
def share_bounds(df: DataFrame, cols=SHARE_COLS, lo: float = 0.10, hi: float = 0.90) -> DataFrame:
    """P10, P90 and mean per share column, plus means normalised to sum 1.

    Shares are unpivoted to (share, value) so one exact-quantile job covers
    all four columns.
    """
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("share"), F.col(c).cast("double").alias("value"))
                                         for c in cols])))
    q = exact_quantiles(long, "value", {"p_lo": lo, "p_hi": hi}, by=["share"], bounded_groups=True)
    means = df.agg(*[F.avg(c).alias(c) for c in cols])
    total = None
    for c in cols:
        total = F.col(c) if total is None else total + F.col(c)
    m = means.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("share_order"), F.lit(c).alias("share"), F.col(c).alias("mean"),
                 pd_div(c, total).alias("mean_normalised")) for i, c in enumerate(cols)])))
    return m.join(F.broadcast(q), "share", "left").select(
        "share_order", "share", "p_lo", "p_hi", "mean", "mean_normalised")


# --- A25 ----------------------------------------------------------------------------
def value_range(df: DataFrame, col: str) -> DataFrame:
    """Min and max (reference-line ends)."""
    return df.agg(F.min(col).alias("min_value"), F.max(col).alias("max_value"))


# --- R1, R3 --------------------------------------------------------------------------
def cuisine_segment_pivot(df: DataFrame, values=None) -> DataFrame:
    """Mean profit, cuisine rows x segment columns.

    The columns are the segments of the data (one small distinct job), so none
    is ever left out; ``values`` skips that job where the domain (A24) is known.
    """
    d = df.where(F.col("CuisineType").isNotNull() & F.col("Segment").isNotNull())
    if values is None:
        values = sorted(r[0] for r in d.select("Segment").distinct().collect())   # one row per category
    return d.groupBy("CuisineType").pivot("Segment", list(values)).agg(F.avg("TotalNetProfit"))


def channels_long(df: DataFrame, key_cols) -> DataFrame:
    """One row per (row, channel): revenue, net profit, margin (0 if no revenue)."""
    structs = []
    for i, (ch, r, p) in enumerate(zip(CHANNELS, REVENUE_COLS, PROFIT_COLS)):
        rev, prof = F.col(r), F.col(p)
        margin = F.when(rev != 0, prof / rev).otherwise(F.lit(0.0))
        structs.append(F.struct(F.lit(i).alias("channel_order"), F.lit(ch).alias("Channel"),
                                rev.alias("Revenue"), prof.alias("NetProfit"), margin.alias("Margin")))
    return df.select(*key_cols, F.inline(F.array(*structs)))
