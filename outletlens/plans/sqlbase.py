"""DuckDB twins of the registered queries (the correctness oracle).

Each oracle is one ANSI-SQL text over the pre-registered driver tables. They
share a CTE chain: ``om`` (outlet-month fixture, identical bits on both
engines), ``feat`` (derived columns), ``t`` (plus the outlier flag). Doubles
are reported at 6 decimals, half-even, on both sides (``R6``).
"""

from __future__ import annotations

FIXTURE_CTES = """
line AS (
  SELECT l_suppkey AS sk, CAST(year(l_shipdate) AS INT) AS yr, CAST(month(l_shipdate) AS INT) AS mo, l_orderkey AS ok,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
         CASE WHEN l_linenumber IN (1, 5) THEN 'IS' WHEN l_linenumber IN (2, 6) THEN 'UE'
              WHEN l_linenumber = 3 THEN 'DD' ELSE 'SD' END AS ch
  FROM lineitem),
agg AS (
  SELECT sk, yr, mo, count(DISTINCT ok) AS n_orders, count(*) AS n_lines,
         sum(CASE WHEN ch = 'IS' THEN 1 ELSE 0 END) AS n_is, sum(CASE WHEN ch = 'UE' THEN 1 ELSE 0 END) AS n_ue,
         sum(CASE WHEN ch = 'DD' THEN 1 ELSE 0 END) AS n_dd, sum(CASE WHEN ch = 'SD' THEN 1 ELSE 0 END) AS n_sd,
         CAST(sum(CASE WHEN ch = 'IS' THEN cents ELSE 0 END) AS BIGINT) AS c_is, CAST(sum(CASE WHEN ch = 'UE' THEN cents ELSE 0 END) AS BIGINT) AS c_ue,
         CAST(sum(CASE WHEN ch = 'DD' THEN cents ELSE 0 END) AS BIGINT) AS c_dd, CAST(sum(CASE WHEN ch = 'SD' THEN cents ELSE 0 END) AS BIGINT) AS c_sd
  FROM line GROUP BY sk, yr, mo),
base AS (
  SELECT a.sk AS RestaurantID, s.s_name AS RestaurantName, a.yr AS Yr, a.mo AS Mo,
         CASE CAST(a.sk % 6 AS INT) WHEN 0 THEN 'Asian' WHEN 1 THEN 'Burgers' WHEN 2 THEN 'Cafe' WHEN 3 THEN 'Indian' WHEN 4 THEN 'Pizza' ELSE 'Seafood' END AS CuisineType,
         CASE CAST(a.sk % 4 AS INT) WHEN 0 THEN 'Casual' WHEN 1 THEN 'Fast' WHEN 2 THEN 'Fine' ELSE 'Ghost' END AS Segment,
         r.r_name AS Subregion, CAST(a.n_orders AS INT) AS MonthlyOrders,
         CAST(a.n_is AS DOUBLE) / a.n_lines AS InStoreShare, CAST(a.n_ue AS DOUBLE) / a.n_lines AS UE_share,
         CAST(a.n_dd AS DOUBLE) / a.n_lines AS DD_share, CAST(a.n_sd AS DOUBLE) / a.n_lines AS SD_share,
         CAST(a.c_is AS DOUBLE) / 1e5 AS InStoreRevenue, CAST(a.c_ue AS DOUBLE) / 1e5 AS UberEatsRevenue,
         CAST(a.c_dd AS DOUBLE) / 1e5 AS DoorDashRevenue, CAST(a.c_sd AS DOUBLE) / 1e5 AS SelfDeliveryRevenue,
         CAST(a.c_is + a.c_ue + a.c_dd + a.c_sd AS DOUBLE) / 1e5 / a.n_orders AS AOV,
         CAST(255 + (a.sk * 13 + a.yr * 12 + a.mo) % 91 AS DOUBLE) / 1e3 AS CommissionRate,
         CAST(89 + (a.sk * 31 + a.mo * 17) % 443 AS DOUBLE) / 1e2 AS DeliveryCostPerOrder,
         CAST(3 + (a.sk * 5 + a.mo) % 16 AS INT) AS DeliveryRadiusKM,
         CAST(990 + (a.sk * 7 + a.mo) % 61 AS DOUBLE) / 1e3 AS GrowthFactor,
         CAST(200 + (a.sk * 17 + a.mo * 3) % 201 AS DOUBLE) / 1e3 AS COGSRate,
         CAST(200 + (a.sk * 29 + a.mo * 11) % 351 AS DOUBLE) / 1e3 AS OPEXRate, a.n_sd AS n_sd
  FROM agg a JOIN supplier s ON s.s_suppkey = a.sk JOIN nation n ON n.n_nationkey = s.s_nationkey
       JOIN region r ON r.r_regionkey = n.n_regionkey),
om AS (
SELECT RestaurantID, RestaurantName, Yr, Mo, CuisineType, Segment, Subregion, MonthlyOrders, InStoreShare, UE_share, DD_share, SD_share,
       InStoreRevenue, UberEatsRevenue, DoorDashRevenue, SelfDeliveryRevenue, AOV, CommissionRate, DeliveryCostPerOrder,
       DeliveryRadiusKM, GrowthFactor, COGSRate, OPEXRate,
       DeliveryCostPerOrder * n_sd AS SD_DeliveryTotalCost,
       InStoreRevenue * (1e0 - COGSRate - OPEXRate) AS InStoreNetProfit,
       UberEatsRevenue * (1e0 - COGSRate - OPEXRate - CommissionRate) AS UberEatsNetProfit,
       DoorDashRevenue * (1e0 - COGSRate - OPEXRate - CommissionRate) AS DoorDashNetProfit,
       SelfDeliveryRevenue * (1e0 - COGSRate - OPEXRate) - DeliveryCostPerOrder * n_sd AS SelfDeliveryNetProfit
FROM base)
"""


def R6(expr: str) -> str:
    """6-decimal half-even report rounding (same as ``compat.r6``)."""
    return f"(CASE WHEN round_even(({expr}) * 1e6, 0) = 0 THEN 0e0 ELSE round_even(({expr}) * 1e6, 0) / 1e6 END)"


def RN(expr: str, digits: int) -> str:
    return (f"(CASE WHEN round_even(({expr}) * 1e{digits}, 0) = 0 THEN 0e0 "
            f"ELSE round_even(({expr}) * 1e{digits}, 0) / 1e{digits} END)")


def PD_DIV(n: str, d: str) -> str:
    """pandas division: x/0 -> +inf / -inf / NULL."""
    return (f"(CASE WHEN ({d}) = 0 THEN (CASE WHEN ({n}) > 0 THEN CAST('inf' AS DOUBLE) "
            f"WHEN ({n}) < 0 THEN CAST('-inf' AS DOUBLE) END) "
            f"ELSE CAST(({n}) AS DOUBLE) / ({d}) END)")


def RATIO0(n: str, d: str) -> str:
    return f"COALESCE(CASE WHEN ({d}) <> 0 THEN CAST(({n}) AS DOUBLE) / ({d}) END, 0e0)"


def CORR(x: str, y: str) -> str:
    """Pearson over pairwise-complete rows; NULL for a constant column."""
    cx = f"CASE WHEN ({x}) IS NOT NULL AND ({y}) IS NOT NULL THEN ({x}) END"
    cy = f"CASE WHEN ({x}) IS NOT NULL AND ({y}) IS NOT NULL THEN ({y}) END"
    den = f"(stddev_pop({cx}) * stddev_pop({cy}))"
    return f"(CASE WHEN {den} = 0 THEN NULL ELSE covar_pop({cx}, {cy}) / {den} END)"


FEATURE_CTES = f"""
feat0 AS (
  SELECT *, InStoreRevenue + UberEatsRevenue + DoorDashRevenue + SelfDeliveryRevenue AS TotalRevenue,
         InStoreNetProfit + UberEatsNetProfit + DoorDashNetProfit + SelfDeliveryNetProfit AS TotalNetProfit
  FROM om),
feat AS (
  SELECT *,
         {PD_DIV('TotalNetProfit', 'MonthlyOrders')} AS NetProfitPerOrder,
         {PD_DIV('TotalNetProfit', 'TotalRevenue')} AS OverallMargin,
         CommissionRate * UE_share AS Commission_UE,
         DeliveryCostPerOrder * SD_share AS DeliveryCost_SD,
         MonthlyOrders * GrowthFactor AS GrowthAdj_Orders,
         COGSRate + OPEXRate AS CostToRevenue,
         (InStoreShare * InStoreNetProfit + UE_share * UberEatsNetProfit)
           / (CASE WHEN TotalNetProfit = 0 THEN 1e0 ELSE TotalNetProfit END) AS ChannelMixScore,
         {RATIO0('InStoreRevenue', 'TotalRevenue')} AS InStoreRevRatio,
         {RATIO0('UberEatsRevenue', 'TotalRevenue')} AS UE_RevRatio,
         {RATIO0('DoorDashRevenue', 'TotalRevenue')} AS DD_RevRatio,
         {RATIO0('SelfDeliveryRevenue', 'TotalRevenue')} AS SD_RevRatio,
         COALESCE({PD_DIV('TotalRevenue', 'MonthlyOrders')}, 0e0) AS RevenuePerOrder,
         COALESCE({PD_DIV('TotalNetProfit', 'MonthlyOrders')}, 0e0) AS ProfitPerOrder
  FROM feat0),
fence AS (
  SELECT q1 - 3e0 * (q3 - q1) AS fence_lo, q3 + 3e0 * (q3 - q1) AS fence_hi
  FROM (SELECT quantile_cont(TotalNetProfit, 0.25) AS q1, quantile_cont(TotalNetProfit, 0.75) AS q3 FROM feat) q),
t AS (
  SELECT feat.*, COALESCE(TotalNetProfit < fence_lo OR TotalNetProfit > fence_hi, false) AS IsOutlier
  FROM feat LEFT JOIN fence ON true)
"""


def with_base(final: str, *extra: str) -> str:
    """Full oracle text: fixture + features + outlier flag + extra CTEs."""
    ctes = [FIXTURE_CTES.strip(), FEATURE_CTES.strip()] + [e.strip() for e in extra if e.strip()]
    return "WITH " + ",\n".join(ctes) + "\n" + final.strip()


def EDGES_CTE(name: str, src: str, col: str, bins: int) -> str:
    """Equal-width edges ``e0..e{bins}`` of ``col`` (same arithmetic as binning.edge_stats)."""
    v = f"CAST({col} AS DOUBLE)"
    s = "CASE WHEN mn = mx THEN mn - (CASE WHEN mn <> 0 THEN 1e-3 * abs(mn) ELSE 1e-3 END) ELSE mn END"
    t = "CASE WHEN mn = mx THEN mx + (CASE WHEN mx <> 0 THEN 1e-3 * abs(mx) ELSE 1e-3 END) ELSE mx END"
    cols = []
    for i in range(bins + 1):
        if i == bins:
            e = "_t"
        else:
            e = f"CAST({i} AS DOUBLE) * ((_t - _s) / CAST({bins} AS DOUBLE)) + _s"
        if i == 0:
            e = f"CASE WHEN _same THEN ({e}) ELSE ({e}) - (_t - _s) * 1e-3 END"
        cols.append(f"{e} AS e{i}")
    return (f"{name} AS (SELECT {', '.join(cols)} FROM (SELECT {s} AS _s, {t} AS _t, mn = mx AS _same "
            f"FROM (SELECT min({v}) AS mn, max({v}) AS mx FROM {src}) m0) m1)")


def BIN_IDX(col: str, edges: str, bins: int) -> str:
    """1-based bin of ``col`` given the edges CTE alias (right-closed)."""
    v = f"CAST({col} AS DOUBLE)"
    terms = " + ".join(f"(CASE WHEN {v} > {edges}.e{i} THEN 1 ELSE 0 END)" for i in range(1, bins))
    return f"(CASE WHEN {col} IS NULL THEN NULL ELSE 1 + {terms} END)"


def BIN_EDGE(edges: str, idx: str, bins: int, upper: bool) -> str:
    off = 1 if upper else 0
    whens = " ".join(f"WHEN {i} THEN {edges}.e{i - 1 + off}" for i in range(1, bins + 1))
    return f"(CASE {idx} {whens} END)"


COMM_BUCKET = ("(CASE WHEN CommissionRate > 0.26e0 AND CommissionRate <= 0.28e0 THEN '27-28%' "
               "WHEN CommissionRate > 0.28e0 AND CommissionRate <= 0.3e0 THEN '28-30%' "
               "WHEN CommissionRate > 0.3e0 AND CommissionRate <= 0.32e0 THEN '30-32%' "
               "WHEN CommissionRate > 0.32e0 AND CommissionRate <= 0.34e0 THEN '32-33%' END)")
COMM_BUCKET_IDX = ("(CASE WHEN CommissionRate > 0.26e0 AND CommissionRate <= 0.28e0 THEN 0 "
                   "WHEN CommissionRate > 0.28e0 AND CommissionRate <= 0.3e0 THEN 1 "
                   "WHEN CommissionRate > 0.3e0 AND CommissionRate <= 0.32e0 THEN 2 "
                   "WHEN CommissionRate > 0.32e0 AND CommissionRate <= 0.34e0 THEN 3 END)")
