"""Sort / limit / top-k operators.

Every top-k is an ``orderBy(...).limit(k)`` with an explicit tie key, which
Spark plans as ``TakeOrderedAndProject``: each task keeps its own k best
rows and only k rows per task reach the final merge, so no full sort or
shuffle of the table happens. Per-group top-k uses a window with
``row_number`` on the group key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.compat import money, pd_div, percent, round_even
from ..schema import KEY_COLS, SCORE_WEIGHTS, TOP20_COLS

def top_n(df: DataFrame, n: int, by: str, key_cols=KEY_COLS, ascending: bool = False) -> DataFrame:
    order = F.col(by).asc_nulls_last() if ascending else F.col(by).desc_nulls_last()
    return df.orderBy(order, *[F.col(k).asc() for k in key_cols]).limit(n)


def top_profit(df: DataFrame, n: int = 20, formatted: bool = True, key_cols=KEY_COLS) -> DataFrame:
    """Top n rows by TotalNetProfit with the display columns. ``key_cols`` are the
    row key (tie-break) of the table at hand, e.g. only the restaurant where it has no month."""
    top = top_n(df, n, "TotalNetProfit", key_cols).select(*key_cols, *TOP20_COLS)
    if not formatted:
        return top
    return top.select(
        *key_cols, "RestaurantName", "CuisineType", "Segment", "Subregion",
        percent("InStoreShare").alias("InStoreShare"), percent("UE_share").alias("UE_share"),
        percent("SD_share").alias("SD_share"), percent("CommissionRate", 1).alias("CommissionRate"),
        money("TotalNetProfit").alias("TotalNetProfit"),
        percent("OverallMargin", 1).alias("OverallMargin"))


def optimisation_score(df: DataFrame) -> DataFrame:
    """Add OptScore (rounded to 2, half-even) from table-wide maxima.

    The maxima are one algebraic aggregate (one row), joined back as a
    broadcast of fixed size.
    """
    mx = df.agg(F.max("TotalNetProfit").alias("_mx_p"), F.max("CommissionRate").alias("_mx_c"),
                F.max("GrowthFactor").alias("_mx_g"))
    w_p, w_c, w_s, w_g = SCORE_WEIGHTS
    raw = (pd_div("TotalNetProfit", "_mx_p") * w_p
           + (F.lit(1.0) - pd_div("CommissionRate", "_mx_c")) * w_c
           + F.col("InStoreShare") * w_s
           + pd_div("GrowthFactor", "_mx_g") * w_g)
    return (df.join(F.broadcast(mx), F.lit(True), "left")
            .withColumn("OptScore", round_even(raw, 2))
            .drop("_mx_p", "_mx_c", "_mx_g"))


def top_score(df: DataFrame, n: int = 15, formatted: bool = True, key_cols=KEY_COLS) -> DataFrame:
    """T2 (flagship): top n outlets by the optimisation score."""
    top = top_n(optimisation_score(df), n, "OptScore", key_cols)
    cols = [*key_cols, "RestaurantName", "CuisineType", "Segment", "Subregion"]
    if not formatted:
        return top.select(*cols, "OptScore", "TotalNetProfit", "CommissionRate")
    return top.select(
        *cols, "OptScore",
        F.format_number("OptScore", 2).alias("OptScoreText"),
        money("TotalNetProfit").alias("TotalNetProfitText"),
        percent("CommissionRate", 1).alias("CommissionRateText"))


def first_by_actual(df: DataFrame, n: int = 120, actual: str = "label", key_cols=KEY_COLS) -> DataFrame:
    """First n rows by actual value, with their 0-based display index."""
    top = df.orderBy(F.col(actual).asc(), *[F.col(k).asc() for k in key_cols]).limit(n)
    w = Window.orderBy(F.col(actual).asc(), *[F.col(k).asc() for k in key_cols])
    return top.withColumn("idx", (F.row_number().over(w) - 1).cast("int"))  # n rows only


def latest_per_group(df: DataFrame, group: str, ts: str, keep: int, tie: str,
                     salt_buckets: int = 64) -> DataFrame:
    """T4: keep the newest ``keep`` rows per group.

    Two stages so a hot group never lands in one task: first the newest
    ``keep`` rows per (group, salt) where salt = hash(tie) mod ``salt_buckets``,
    then a window over the survivors (at most ``keep x salt_buckets`` rows
    per group).
    """
    order = [F.col(ts).desc(), F.col(tie).desc()]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(F.col(tie)), F.lit(salt_buckets)))
    w1 = Window.partitionBy(group, "_salt").orderBy(*order)
    stage1 = salted.withColumn("_r", F.row_number().over(w1)).where(F.col("_r") <= keep).drop("_r", "_salt")
    w2 = Window.partitionBy(group).orderBy(*order)
    return (stage1.withColumn("recency", F.row_number().over(w2))
            .where(F.col("recency") <= keep))


def best_model(metrics: DataFrame, score: str = "R2", order_col: str = "model_order") -> DataFrame:
    """T5: highest score, first in declaration order on ties."""
    return metrics.orderBy(F.col(score).desc_nulls_last(), F.col(order_col).asc()).limit(1)
