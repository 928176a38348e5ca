"""Derived columns (P1-P11) and the outlier flag (F1, F2).

All projections are narrow: they fuse into the scan's whole-stage codegen
and add no shuffle. The outlier fence needs two global quartiles, computed
by the exact skew-proof quantile operator and joined back as one broadcast
row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.compat import null_nan, pd_div, ratio_or_zero, zero_to_one
from ..functions.quantiles import exact_quantiles
from ..schema import OUTLIER_IQR_FACTOR, PROFIT_COLS, RATIO_COLS, REVENUE_COLS


def _sum(cols):
    out = F.col(cols[0])
    for c in cols[1:]:
        out = out + F.col(c)
    return out


def derive(df: DataFrame) -> DataFrame:
    """Add P1-P11. NaN inputs are normalised to NULL first."""
    doubles = [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    df = df.withColumns({c: null_nan(c) for c in doubles})
    df = df.withColumns({
        "TotalRevenue": _sum(REVENUE_COLS),                                      # P1
        "TotalNetProfit": _sum(PROFIT_COLS),                                     # P2
    })
    tr, tp, orders = F.col("TotalRevenue"), F.col("TotalNetProfit"), F.col("MonthlyOrders")
    return df.withColumns({
        "NetProfitPerOrder": pd_div(tp, orders),                                 # P3
        "OverallMargin": pd_div(tp, tr),                                         # P4
        "Commission_UE": F.col("CommissionRate") * F.col("UE_share"),            # P5
        "DeliveryCost_SD": F.col("DeliveryCostPerOrder") * F.col("SD_share"),    # P6
        "GrowthAdj_Orders": orders * F.col("GrowthFactor"),                      # P7
        "CostToRevenue": F.col("COGSRate") + F.col("OPEXRate"),                  # P8
        "ChannelMixScore": (F.col("InStoreShare") * F.col("InStoreNetProfit")    # P9
                            + F.col("UE_share") * F.col("UberEatsNetProfit")) / zero_to_one(tp),
        **{r: ratio_or_zero(c, tr) for r, c in zip(RATIO_COLS, REVENUE_COLS)},  # P10
        "RevenuePerOrder": F.coalesce(pd_div(tr, orders), F.lit(0.0)),           # P11
        "ProfitPerOrder": F.coalesce(pd_div(tp, orders), F.lit(0.0)),
    })


def outlier_fence(df: DataFrame, col: str = "TotalNetProfit",
                  factor: float = OUTLIER_IQR_FACTOR) -> DataFrame:
    """One row: q1, q3, low and high fence of ``col`` (linear quartiles)."""
    q = exact_quantiles(df, col, {"q1": 0.25, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    return q.select("q1", "q3", (F.col("q1") - factor * iqr).alias("fence_lo"),
                    (F.col("q3") + factor * iqr).alias("fence_hi"))


def outside(value, lo, hi):
    """Strictly outside [lo, hi]; false where anything is missing."""
    return F.coalesce((value < lo.cast("double")) | (value > hi.cast("double")), F.lit(False))


def flag_outliers(df: DataFrame, col: str = "TotalNetProfit",
                  factor: float = OUTLIER_IQR_FACTOR) -> DataFrame:
    """strict 3xIQR fence; NULL values are not outliers."""
    fence = outlier_fence(df, col, factor).select("fence_lo", "fence_hi")
    v = F.col(col)
    # one row (or none for an empty table), fixed size -> broadcast
    out = df.join(F.broadcast(fence), F.lit(True), "left")
    return out.withColumn("IsOutlier", outside(v, F.col("fence_lo"), F.col("fence_hi"))).drop("fence_lo", "fence_hi")


def exclude_outliers(df: DataFrame) -> DataFrame:
    """F2."""
    return df.where(~F.col("IsOutlier"))


def prepare(df: DataFrame) -> DataFrame:
    """Derived columns plus the outlier flag: the analysis base table."""
    return flag_outliers(derive(df))
