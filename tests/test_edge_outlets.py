import math

from pyspark.sql import functions as F

from tests.helpers import frame, outlet_row
from outletlens.functions.binning import commission_bucket, edge_stats
from outletlens.operators import aggregates as A
from outletlens.operators import features, ranking


def edge_frame(spark):
    rows = [
        outlet_row(RestaurantID=1, MonthlyOrders=0),                                         # +inf per order
        outlet_row(RestaurantID=2, MonthlyOrders=0, InStoreNetProfit=-500.0),                # -inf
        outlet_row(RestaurantID=3, MonthlyOrders=0, InStoreNetProfit=-70.0),                 # 0/0 -> NULL, PPO 0
        outlet_row(RestaurantID=4, InStoreRevenue=0.0, UberEatsRevenue=0.0, DoorDashRevenue=0.0,
                   SelfDeliveryRevenue=0.0),                                                 # zero revenue
        outlet_row(RestaurantID=5, InStoreNetProfit=-70.0),                                  # profit exactly 0
        outlet_row(RestaurantID=6, DoorDashRevenue=None),                                    # NULL revenue
        outlet_row(RestaurantID=7, CuisineType=None),                                        # NULL category
        outlet_row(RestaurantID=8, CommissionRate=0.26),                                     # no bucket
        outlet_row(RestaurantID=9, CommissionRate=0.28),                                     # 27-28%
        outlet_row(RestaurantID=13, CommissionRate=0.34),                                    # 32-33%
        outlet_row(RestaurantID=10, SelfDeliveryNetProfit=float("nan")),                     # NaN -> NULL
        outlet_row(RestaurantID=11, InStoreNetProfit=999.0),
        outlet_row(RestaurantID=12, InStoreNetProfit=999.0),                                 # tie with 11
    ]
    return frame(spark, rows)


def test_derived_edge_semantics(spark):
    d = {r.RestaurantID: r for r in features.derive(edge_frame(spark)).collect()}
    assert d[1].NetProfitPerOrder == math.inf and d[2].NetProfitPerOrder == -math.inf
    assert d[3].NetProfitPerOrder is None and d[3].ProfitPerOrder == 0.0
    assert d[1].ProfitPerOrder == math.inf           # fillna keeps inf
    assert d[4].InStoreRevRatio == 0.0 and d[4].OverallMargin == math.inf
    assert d[5].TotalNetProfit == 0.0 and d[5].ChannelMixScore == (0.4 * -70.0 + 0.3 * 30.0) / 1.0
    assert d[6].TotalRevenue is None and d[6].InStoreRevRatio == 0.0
    assert d[10].SelfDeliveryNetProfit is None and d[10].TotalNetProfit is None


def test_commission_buckets_right_closed(spark):
    b = {r.RestaurantID: r.CommBucket for r in commission_bucket(edge_frame(spark)).collect()}
    assert b[8] is None and b[9] == "27-28%" and b[13] == "32-33%" and b[1] == "28-30%"


def test_group_ops_drop_null_keys_and_ties(spark):
    t = features.prepare(edge_frame(spark))
    g = A.group_means(t, "CuisineType", "TotalRevenue").collect()
    assert all(r.CuisineType is not None for r in g)
    top = ranking.top_n(t, 2, "TotalNetProfit").collect()
    assert [r.RestaurantID for r in top] == [11, 12]


def test_constant_column_edges_and_corr(spark):
    df = spark.createDataFrame([(5.0, 1.0), (5.0, 2.0)], "c double, v double")
    e = edge_stats(df, "c", 5).first()
    assert abs(e.e0 - 4.995) < 1e-12 and abs(e.e5 - 5.005) < 1e-12
    r = A.correlation_matrix(df, ["c", "v"]).first()
    assert r.r is None


def test_empty_frame_keeps_schema(spark):
    t = features.prepare(edge_frame(spark)).where(F.lit(False))
    assert A.kpi_summary(t).first().n_restaurants == 0
    assert A.group_means(t, "Segment", "TotalNetProfit").count() == 0
    assert "OptScore" in ranking.optimisation_score(t).columns


def test_correlation_paths_agree_pairwise_complete(spark):
    import numpy as np
    rng = np.random.default_rng(9)
    a, b, c = rng.normal(size=(3, 50))
    rows = [(float(x), float(y), float(z)) for x, y, z in zip(a, b, c)]
    full = spark.createDataFrame(rows, "a double, b double, c double")
    fast = {(r.x, r.y): r.r for r in A.correlation_matrix(full, ["a", "b", "c"]).collect()}
    holed = spark.createDataFrame(rows[:-1] + [(None, rows[-1][1], rows[-1][2])], "a double, b double, c double")
    slow = {(r.x, r.y): r.r for r in A.correlation_matrix(holed, ["a", "b", "c"]).collect()}
    assert abs(fast[("a", "b")] - np.corrcoef(a, b)[0, 1]) < 1e-12
    assert abs(slow[("b", "c")] - np.corrcoef(b, c)[0, 1]) < 1e-12          # no NULL in b, c: all rows
    assert abs(slow[("a", "b")] - np.corrcoef(a[:-1], b[:-1])[0, 1]) < 1e-12  # pairwise-complete
