"""Rows and paths that several test modules use."""

SF_SMALL = "/root/testdata/sf0.001"


def outlet_row(**kw):
    """A full OUTLET row with plausible defaults (overridable)."""
    base = dict(RestaurantID=1, RestaurantName="R1", Yr=1998, Mo=1, CuisineType="Asian", Segment="Casual",
                Subregion="ASIA", MonthlyOrders=100, InStoreShare=0.4, UE_share=0.3, DD_share=0.2, SD_share=0.1,
                InStoreRevenue=400.0, UberEatsRevenue=300.0, DoorDashRevenue=200.0, SelfDeliveryRevenue=100.0,
                AOV=10.0, CommissionRate=0.30, DeliveryCostPerOrder=2.0, DeliveryRadiusKM=5, GrowthFactor=1.0,
                COGSRate=0.3, OPEXRate=0.3, SD_DeliveryTotalCost=20.0, InStoreNetProfit=160.0,
                UberEatsNetProfit=30.0, DoorDashNetProfit=20.0, SelfDeliveryNetProfit=20.0)
    base.update(kw)
    return base


def frame(spark, rows):
    from outletlens.schema import OUTLET
    return spark.createDataFrame([tuple(r[f.name] for f in OUTLET.fields) for r in rows], OUTLET)
