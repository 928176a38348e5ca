"""Outlet-month table derived from the TPC-H-style driver tables.

Grain: one row per supplier ("restaurant") x ship year x ship month. Money
is summed as integer cents and rates are integers divided once, so the
result is bit-identical to the same SQL run on another engine.

Plan shape (why it holds at scale):
* ``lineitem`` is read with only 5 columns (column pruning reaches the scan).
* Lines are shuffled once, by (supp, yr, mo), as five short columns; the per-order level ``(supp, yr, mo, order)``
  and the per-month level are both aggregates on that partitioning, so no wider rows of sums are shuffled (an
  order rarely has two lines of one supplier, so summing before the shuffle would save no rows). A supplier holding a
  third of all lines is spread over its months, and the distinct-order count never builds a per-group set.
* ``nation`` (25 rows) and ``region`` (5 rows) are fixed-size TPC-H tables
  and are broadcast; ``supplier`` grows with the scale factor, so its join
  is left to the planner / AQE (sort-merge at scale, broadcast when small).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import OUTLET

# Label tables of the synthetic outlet attributes.
CUISINES = ["Asian", "Burgers", "Cafe", "Indian", "Pizza", "Seafood"]
SEGMENTS = ["Casual", "Fast", "Fine", "Ghost"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _label(code, labels) -> F.Column:
    expr = F.when(code == 0, F.lit(labels[0]))
    for i, lab in enumerate(labels[1:-1], start=1):
        expr = expr.when(code == i, F.lit(lab))
    return expr.otherwise(F.lit(labels[-1]))


def _channel_sum(flag: int, value) -> F.Column:
    return F.sum(F.when(F.col("ch") == flag, value).otherwise(F.lit(0)))


def outlet_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    line = li.select(
        F.col("l_suppkey").alias("sk"),
        F.year("l_shipdate").cast("int").alias("yr"),
        F.month("l_shipdate").cast("int").alias("mo"),
        F.col("l_orderkey").alias("ok"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"),
        F.when(F.col("l_linenumber").isin(1, 5), 0)
         .when(F.col("l_linenumber").isin(2, 6), 1)
         .when(F.col("l_linenumber") == 3, 2).otherwise(3).cast("tinyint").alias("ch"),
    ).repartition("sk", "yr", "mo")
    # Level 1: one row per (supplier, month, order) -> distinct orders by count.
    per_order = line.groupBy("sk", "yr", "mo", "ok").agg(
        F.count(F.lit(1)).alias("n_lines"),
        _channel_sum(0, F.lit(1)).alias("n_is"),
        _channel_sum(1, F.lit(1)).alias("n_ue"),
        _channel_sum(2, F.lit(1)).alias("n_dd"),
        _channel_sum(3, F.lit(1)).alias("n_sd"),
        _channel_sum(0, F.col("cents")).alias("c_is"),
        _channel_sum(1, F.col("cents")).alias("c_ue"),
        _channel_sum(2, F.col("cents")).alias("c_dd"),
        _channel_sum(3, F.col("cents")).alias("c_sd"),
    )
    # Level 2: one row per (supplier, month).
    agg = per_order.groupBy("sk", "yr", "mo").agg(
        F.count(F.lit(1)).alias("n_orders"),
        *[F.sum(c).cast("bigint").alias(c) for c in
          ["n_lines", "n_is", "n_ue", "n_dd", "n_sd", "c_is", "c_ue", "c_dd", "c_sd"]],
    )
    supplier = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    supp_region = (supplier
                   .join(F.broadcast(nation), supplier.s_nationkey == nation.n_nationkey)
                   .join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)
                   .select("s_suppkey", "s_name", "r_name"))
    a = agg.join(supp_region, agg.sk == supp_region.s_suppkey)

    sk, yr, mo = F.col("sk"), F.col("yr"), F.col("mo")
    n_lines, n_orders = F.col("n_lines"), F.col("n_orders")
    base = a.select(
        sk.alias("RestaurantID"), F.col("s_name").alias("RestaurantName"),
        yr.alias("Yr"), mo.alias("Mo"),
        _label((sk % 6).cast("int"), CUISINES).alias("CuisineType"),
        _label((sk % 4).cast("int"), SEGMENTS).alias("Segment"),
        F.col("r_name").alias("Subregion"),
        n_orders.cast("int").alias("MonthlyOrders"),
        (F.col("n_is").cast("double") / n_lines).alias("InStoreShare"),
        (F.col("n_ue").cast("double") / n_lines).alias("UE_share"),
        (F.col("n_dd").cast("double") / n_lines).alias("DD_share"),
        (F.col("n_sd").cast("double") / n_lines).alias("SD_share"),
        (F.col("c_is").cast("double") / 1e5).alias("InStoreRevenue"),
        (F.col("c_ue").cast("double") / 1e5).alias("UberEatsRevenue"),
        (F.col("c_dd").cast("double") / 1e5).alias("DoorDashRevenue"),
        (F.col("c_sd").cast("double") / 1e5).alias("SelfDeliveryRevenue"),
        ((F.col("c_is") + F.col("c_ue") + F.col("c_dd") + F.col("c_sd")).cast("double")
         / 1e5 / n_orders).alias("AOV"),
        ((255 + (sk * 13 + yr * 12 + mo) % 91).cast("double") / 1e3).alias("CommissionRate"),
        ((89 + (sk * 31 + mo * 17) % 443).cast("double") / 1e2).alias("DeliveryCostPerOrder"),
        (3 + (sk * 5 + mo) % 16).cast("int").alias("DeliveryRadiusKM"),
        ((990 + (sk * 7 + mo) % 61).cast("double") / 1e3).alias("GrowthFactor"),
        ((200 + (sk * 17 + mo * 3) % 201).cast("double") / 1e3).alias("COGSRate"),
        ((200 + (sk * 29 + mo * 11) % 351).cast("double") / 1e3).alias("OPEXRate"),
        F.col("n_sd"),
    )
    one = F.lit(1.0)
    cogs, opex, comm = F.col("COGSRate"), F.col("OPEXRate"), F.col("CommissionRate")
    out = base.select(
        *[c for c in base.columns if c != "n_sd"],
        (F.col("DeliveryCostPerOrder") * F.col("n_sd")).alias("SD_DeliveryTotalCost"),
        (F.col("InStoreRevenue") * (one - cogs - opex)).alias("InStoreNetProfit"),
        (F.col("UberEatsRevenue") * (one - cogs - opex - comm)).alias("UberEatsNetProfit"),
        (F.col("DoorDashRevenue") * (one - cogs - opex - comm)).alias("DoorDashNetProfit"),
        (F.col("SelfDeliveryRevenue") * (one - cogs - opex)
         - F.col("DeliveryCostPerOrder") * F.col("n_sd")).alias("SelfDeliveryNetProfit"),
    )
    return out.select(*[F.col(f.name).cast(f.dataType) for f in OUTLET.fields])


def scenarios_from_outlets(outlets: DataFrame) -> DataFrame:
    """Bulk scenario table: every outlet-month observation becomes a what-if
    scenario with its own inputs (so the scenario count grows with the data).

    ``scenario_id`` = RestaurantID * 10^6 + Yr * 100 + Mo; ``user`` is the
    subregion; ``saved_at`` orders scenarios by month, then outlet.
    """
    o = outlets
    return o.select(
        (F.col("RestaurantID") * 1000000 + F.col("Yr") * 100 + F.col("Mo")).cast("bigint").alias("scenario_id"),
        F.col("RestaurantName").alias("name"),
        F.col("Subregion").alias("user"),
        F.col("InStoreShare").alias("in_store"), F.col("UE_share").alias("ue_share"),
        F.col("DD_share").alias("dd_share"), F.col("SD_share").alias("sd_share"),
        F.col("CommissionRate").alias("commission"),
        F.col("DeliveryCostPerOrder").alias("delivery_cost"),
        F.col("DeliveryRadiusKM").alias("radius"), F.col("GrowthFactor").alias("growth"),
        F.col("AOV").alias("aov"), F.col("MonthlyOrders").alias("orders"),
        F.col("COGSRate").alias("cogs"), F.col("OPEXRate").alias("opex"),
        F.col("CuisineType").alias("cuisine"), F.col("Segment").alias("segment"),
        F.col("Subregion").alias("subregion"),
        F.timestamp_seconds(F.unix_timestamp(F.make_date(F.col("Yr"), F.col("Mo"), F.lit(1)))
                            + F.col("RestaurantID")).alias("saved_at"),
    )
