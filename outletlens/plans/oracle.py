"""SQL twins of ``catalog.QUERIES`` (DuckDB dialect, ANSI where possible)."""

from __future__ import annotations

from .sqlbase import R6, with_base

KEY = "RestaurantID, Yr, Mo"
ORACLES: dict[str, str] = {}


def _cols(name, *cols, table="feat"):
    sel = ", ".join(f"{R6(c)} AS {c}" for c in cols)
    ORACLES[name] = with_base(f"SELECT {KEY}, {sel} FROM {table}")


# --- P -------------------------------------------------------------------------
_cols("p1_total_revenue", "TotalRevenue")
_cols("p2_total_net_profit", "TotalNetProfit")
_cols("p3_net_profit_per_order", "NetProfitPerOrder")
_cols("p4_overall_margin", "OverallMargin")
_cols("p5_commission_ue", "Commission_UE")
_cols("p6_delivery_cost_sd", "DeliveryCost_SD")
_cols("p7_growth_adj_orders", "GrowthAdj_Orders")
_cols("p8_cost_to_revenue", "CostToRevenue")
_cols("p9_channel_mix_score", "ChannelMixScore")
_cols("p10_revenue_ratios", "InStoreRevRatio", "UE_RevRatio", "DD_RevRatio", "SD_RevRatio")
_cols("p11_per_order_values", "RevenuePerOrder", "ProfitPerOrder")

# --- F -------------------------------------------------------------------------
ORACLES["f1_outlier_flags"] = with_base(
    f"SELECT {KEY}, {R6('TotalNetProfit')} AS TotalNetProfit, IsOutlier FROM t")
ORACLES["f2_exclude_outliers"] = with_base(
    f"SELECT {KEY}, {R6('TotalNetProfit')} AS TotalNetProfit FROM t WHERE NOT IsOutlier")
