"""The data behind the charts: histograms, box and violin summaries, trend
lines, binned scatter and break-even crossings (B3-B8).

Scale notes:
* Histogram, box and KDE inputs are reduced to per-(group, bin) counts by
  one partial aggregate before anything else happens; after that every step
  works on tables bounded by ``groups x bins`` rows, whatever the data size.
* Quantiles use :func:`exact_quantiles` (range-partitioned, skew-proof).
* Trend lines are the SQL ``regr_*`` aggregates (algebraic, map-side
  combined); a group with one row or zero x-variance gives NULL, no error.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.binning import _finite, assign_bins, edge_stats
from ..functions.compat import col_, null_nan
from ..functions.quantiles import exact_quantiles
from ..session import broadcast_if_small

# The eight trend-line sites of the dashboard (x, y, colour group).
TREND_SITES = [
    ("CommissionRate", "UberEatsNetProfit", "CuisineType"),
    ("DeliveryCostPerOrder", "SelfDeliveryNetProfit", "Subregion"),
    ("InStoreShare", "InStoreNetProfit", "Segment"),
    ("DeliveryRadiusKM", "SelfDeliveryNetProfit", "CuisineType"),
    ("InStoreShare", "TotalNetProfit", "Segment"),
    ("SD_share", "SelfDeliveryNetProfit", "Subregion"),
    ("DeliveryCostPerOrder", "SelfDeliveryNetProfit", "Subregion"),
    ("DeliveryRadiusKM", "SelfDeliveryNetProfit", "Segment"),
]
# Sites drawn with a y = 0 break-even line (indexes into TREND_SITES).
BREAK_EVEN_SITES = [6, 7]


# --- B3 -------------------------------------------------------------------------
def histogram(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """Equal-width histogram: every bin 1..n with its edges and count (0 if empty)."""
    edges = edge_stats(df, col, bins)                       # one row, computed once
    counted = (assign_bins(df, col, bins, "bin", stats=edges).where(F.col("bin").isNotNull())
               .groupBy("bin").agg(F.count(F.lit(1)).alias("count")))
    all_bins = edges.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("bin"), F.col(f"e{i - 1}").alias("lo"), F.col(f"e{i}").alias("hi"))
        for i in range(1, bins + 1)])))
    return (all_bins.join(F.broadcast(counted), "bin", "left")   # <= bins rows
            .select("bin", "lo", "hi", F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count")))


def nice_edges(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """One row (``width, first, n``): bins of width 1, 2 or 5 times a power of ten that start at a multiple of
    the width, the narrowest of which at most ``bins`` cover the finite values. Bin ``i`` is
    ``[(first + i - 1) * width, (first + i) * width)``. A constant column has one bin of width 1, an empty one no row.
    ``bins`` is 2 or more (values on both sides of zero never fit one aligned bin)."""
    if bins < 2:
        raise ValueError("bins must be 2 or more")
    v = _finite(col)
    mm = df.agg(F.min(v).alias("mn"), F.max(v).alias("mx")).where(F.col("mn").isNotNull())
    raw = (F.col("mx") - F.col("mn")) / F.lit(float(bins))
    ten = F.pow(F.lit(10.0), F.floor(F.log10(raw)).cast("double"))
    # the two narrowest widths not below a bin's share; aligned bins may need one more than fits the narrower
    nice = F.when(raw <= ten, F.array(F.lit(1.0), F.lit(2.0))).when(raw <= ten * 2, F.array(F.lit(2.0), F.lit(5.0))) \
            .when(raw <= ten * 5, F.array(F.lit(5.0), F.lit(10.0))).otherwise(F.array(F.lit(10.0), F.lit(20.0)))
    widths = F.when(raw > 0, F.transform(nice, lambda f: f * ten)).otherwise(F.array(F.lit(1.0)))
    at = lambda c, w: F.floor(F.col(c) / w)
    fits = F.filter(widths, lambda w: at("mx", w) - at("mn", w) + 1 <= bins)
    mm = mm.withColumn("width", F.coalesce(F.get(fits, F.lit(0)), F.element_at(widths, -1)))
    w = F.col("width")
    return mm.select("width", at("mn", w).alias("first"), (at("mx", w) - at("mn", w) + 1).cast("int").alias("n"))


def nice_histogram(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """B3 with axis-friendly bins [L] (:func:`nice_edges`): every bin 1..n with its edges and count (0 if empty).
    NULL, NaN and infinite values have no bin."""
    edges = F.broadcast(nice_edges(df, col, bins))                    # one row
    v = _finite(col)
    counted = (df.select(v.alias("_v")).where(F.col("_v").isNotNull()).join(edges, F.lit(True))
               .select((F.floor(F.col("_v") / F.col("width")) - F.col("first") + 1).cast("int").alias("bin"))
               .groupBy("bin").agg(F.count(F.lit(1)).alias("count")))
    at = lambda i: (F.col("first") + i).cast("double") * F.col("width")
    all_bins = edges.select("first", "width", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("bin"))
    return (all_bins.join(F.broadcast(counted), "bin", "left")        # <= bins rows
            .select("bin", at(F.col("bin") - 1).alias("lo"), at(F.col("bin")).alias("hi"),
                    F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count")))


# --- B4 -------------------------------------------------------------------------
def box_stats(df: DataFrame, col: str, by: str, whisker: float = 1.5) -> DataFrame:
    """Per group: n, q1, median, q3, whisker ends (furthest values inside the
    1.5 IQR fences), and the number of points outside them."""
    d = df.where(F.col(by).isNotNull()).select(by, null_nan(col_(col).cast("double")).alias("v"))
    q = exact_quantiles(d, "v", {"q1": 0.25, "median": 0.5, "q3": 0.75}, by=[by])
    iqr = F.col("q3") - F.col("q1")
    fences = q.select(by, "q1", "median", "q3",
                      (F.col("q1") - whisker * iqr).alias("_lo"), (F.col("q3") + whisker * iqr).alias("_hi"))
    # one row per group: broadcast behind a size check
    joined = d.where(F.col("v").isNotNull()).join(broadcast_if_small(fences), by)
    inside = (F.col("v") >= F.col("_lo")) & (F.col("v") <= F.col("_hi"))
    return joined.groupBy(by, "q1", "median", "q3").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(inside, F.col("v"))).alias("whisker_lo"),
        F.max(F.when(inside, F.col("v"))).alias("whisker_hi"),
        F.count_if(~inside).alias("n_outside"))


# --- B5 -------------------------------------------------------------------------
def violin_density(df: DataFrame, col: str, by: str, grid: int = 50, fine_bins: int = 512,
                   reach: float = 0.0) -> DataFrame:
    """Gaussian KDE of ``col`` per group on ``grid`` points spanning the group's
    range, or ``reach`` bandwidths more on either side (a plotting library's soft
    span has 2) [L]. Bandwidth: Silverman's rule ``1.059 * min(sd, IQR/1.349) * n^-1/5``.

    Binned KDE: rows are first counted into ``fine_bins`` equal bins per group
    (a partial aggregate), then each grid point sums the Gaussian kernel over
    bin centres. The kernel step joins two tables of at most
    ``groups x fine_bins`` and ``groups x grid`` rows, independent of the data size.
    """
    d = (df.where(F.col(by).isNotNull())
         .select(by, null_nan(col_(col).cast("double")).alias("v"))
         .where(F.abs(F.col("v")) < F.lit(float("inf"))))          # infinite values have no place on the axis
    q = exact_quantiles(d, "v", {"q1": 0.25, "q3": 0.75}, by=[by])
    st = d.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("v").alias("sd"),
                           F.min("v").alias("mn"), F.max("v").alias("mx"))
    st = broadcast_if_small(st.join(q, by))
    # a group of one row (no deviation) or without spread has no bandwidth: its density is NULL
    spread = F.when(F.col("sd").isNotNull(), F.least(F.col("sd"), (F.col("q3") - F.col("q1")) / F.lit(1.349)))
    h = F.when(spread > 0, F.lit(1.059) * spread * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
    st = st.select(by, "n", "mn", "mx", h.alias("bw"),
                   ((F.col("mx") - F.col("mn")) / F.lit(float(fine_bins))).alias("w"))
    fb = F.least(F.floor(F.try_divide(F.col("v") - F.col("mn"), F.col("w"))), F.lit(fine_bins - 1))
    binned = (d.join(st.select(by, "mn", "w"), by)   # st: size-checked broadcast above
              .select(by, F.when(F.col("w") > 0, fb).otherwise(F.lit(0)).cast("int").alias("fb"))
              .groupBy(by, "fb").agg(F.count(F.lit(1)).alias("c")))
    pts = st.select(by, "n", "bw", "mn", "mx", "w",
                    F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("gi"))
    lo, hi = F.col("mn"), F.col("mx")
    if reach:
        more = F.lit(float(reach)) * F.coalesce(F.col("bw"), F.lit(0.0))
        lo, hi = lo - more, hi + more
    pts = pts.withColumn("x", lo + (hi - lo) * F.col("gi").cast("double") / F.lit(float(grid - 1)))
    centre = F.col("mn") + (F.col("fb").cast("double") + F.lit(0.5)) * F.col("w")
    z = (F.col("x") - centre) / F.col("bw")
    kern = F.col("c").cast("double") * F.exp(F.lit(-0.5) * z * z)
    dens = (pts.join(binned, by)
            .groupBy(by, "gi", "x", "n", "bw")
            .agg(F.sum(kern).alias("_k")))
    norm = F.col("n").cast("double") * F.col("bw") * F.sqrt(F.lit(2.0 * math.pi))
    return dens.select(by, "gi", "x", "bw", F.try_divide(F.col("_k"), norm).alias("density"))


# --- B6, B8 -----------------------------------------------------------------------
def all_trend_lines(df: DataFrame, sites=TREND_SITES) -> DataFrame:
    """B6 for every site, long: (site, x, y, group_col, group, slope, intercept, r2, n).

    One scan for all sites: ``groupingSets`` over the distinct colour columns
    (an Expand of one copy per colour column, then one map-side-combined
    aggregate holding every site's regression sums); each site then reads
    the rows of its own grouping set.
    """
    group_cols = list(dict.fromkeys(by for _, _, by in sites))
    d = df
    aggs = []
    for i, (x, y, _by) in enumerate(sites):
        xv, yv = col_(x).cast("double"), col_(y).cast("double")
        aggs += [F.regr_slope(yv, xv).alias(f"s{i}"), F.regr_intercept(yv, xv).alias(f"i{i}"),
                 F.regr_r2(yv, xv).alias(f"r{i}"), F.regr_count(yv, xv).alias(f"n{i}")]
    aggs += [F.grouping(c).alias(f"_g_{c}") for c in group_cols]
    g = d.groupingSets([[c] for c in group_cols], *group_cols).agg(*aggs)
    # one projection over the grouped rows (so every site shares the one scan):
    # each row emits the sites whose colour column is its grouping set
    per_site = []
    for i, (x, y, by) in enumerate(sites):
        st = F.struct(F.lit(i).alias("site"), F.lit(x).alias("x"), F.lit(y).alias("y"),
                      F.lit(by).alias("group_col"), F.col(by).alias("group"), F.col(f"s{i}").alias("slope"),
                      F.col(f"i{i}").alias("intercept"), F.col(f"r{i}").alias("r2"), F.col(f"n{i}").alias("n"))
        per_site.append(F.when((F.col(f"_g_{by}") == 0) & F.col(by).isNotNull(), st))
    return g.select(F.inline(F.filter(F.array(*per_site), lambda e: e.isNotNull())))


def break_even_x(trends: DataFrame) -> DataFrame:
    """X where the fitted line crosses y = 0 (NULL for a flat line)."""
    return trends.withColumn("break_even_x", F.try_divide(-F.col("intercept"), F.col("slope")))


# --- B7 ---------------------------------------------------------------------------
def scatter_bins(df: DataFrame, x: str, y: str, color: str | None = None, size: str | None = None,
                 bins: int = 50, mean_color: str | None = None) -> DataFrame:
    """Scatter at scale: counts (and the mean marker size, or the mean of a continuous
    colour) per 2-D bin, and per category of ``color`` where one is given."""
    b = assign_bins(df, x, bins, "xb")
    b = assign_bins(b, y, bins, "yb").where(F.col("xb").isNotNull() & F.col("yb").isNotNull())
    by = []
    if color:
        b, by = b.where(F.col(color).isNotNull()), [color]
    aggs = [F.count(F.lit(1)).alias("n")]
    if size:
        aggs.append(F.avg(size).alias("mean_size"))
    if mean_color:
        aggs.append(F.avg(mean_color).alias("mean_color"))
    return b.groupBy(*by, "xb", "xb_lo", "xb_hi", "yb", "yb_lo", "yb_hi").agg(*aggs)
