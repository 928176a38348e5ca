"""Schemas and fixed names shared by every operator.

Fixed values: column names, channel labels, feature order, bucket edges and
labels, and the recommendation cost targets below must stay exactly as
written for results to line up with the dashboard they re-express.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (names and constants that results depend on)
# ---------------------------------------------------------------------------
CHANNELS = ["In-Store", "Uber Eats", "DoorDash", "Self-Delivery"]
SHARE_COLS = ["InStoreShare", "UE_share", "DD_share", "SD_share"]
REVENUE_COLS = ["InStoreRevenue", "UberEatsRevenue", "DoorDashRevenue", "SelfDeliveryRevenue"]
PROFIT_COLS = ["InStoreNetProfit", "UberEatsNetProfit", "DoorDashNetProfit", "SelfDeliveryNetProfit"]
RATIO_COLS = ["InStoreRevRatio", "UE_RevRatio", "DD_RevRatio", "SD_RevRatio"]
CATEGORY_COLS = ["CuisineType", "Segment", "Subregion"]

FEATURES = [
    "InStoreShare", "UE_share", "DD_share", "SD_share",
    "CommissionRate", "DeliveryCostPerOrder", "DeliveryRadiusKM", "GrowthFactor",
    "AOV", "MonthlyOrders", "COGSRate", "OPEXRate",
    "Commission_UE", "DeliveryCost_SD", "GrowthAdj_Orders", "CostToRevenue",
    "InStoreRevRatio", "UE_RevRatio", "DD_RevRatio", "SD_RevRatio",
    "RevenuePerOrder", "ProfitPerOrder",
    "CuisineType_enc", "Segment_enc", "Subregion_enc",
]
TARGET = "TotalNetProfit"
# Columns shown by the top-20 table.
TOP20_COLS = ["RestaurantName", "CuisineType", "Segment", "Subregion",
              "InStoreShare", "UE_share", "SD_share", "CommissionRate",
              "TotalNetProfit", "OverallMargin"]
# Features derived from the row's own revenue and profit.
LEAKY_FEATURES = ["InStoreRevRatio", "UE_RevRatio", "DD_RevRatio", "SD_RevRatio",
                  "RevenuePerOrder", "ProfitPerOrder"]
SECONDARY_TARGETS = ["NetProfitPerOrder", "OverallMargin"]

CORR_COLS = ["TotalNetProfit", "TotalRevenue", "MonthlyOrders", "AOV",
             "InStoreShare", "UE_share", "DD_share", "SD_share",
             "COGSRate", "OPEXRate", "CommissionRate",
             "DeliveryRadiusKM", "DeliveryCostPerOrder", "GrowthFactor"]

# Commission buckets: right-closed edges and their labels (labels kept verbatim).
COMMISSION_EDGES = [0.26, 0.28, 0.30, 0.32, 0.34]
COMMISSION_LABELS = ["27-28%", "28-30%", "30-32%", "32-33%"]
COMMISSION_SPLIT = 0.30
OUTLIER_IQR_FACTOR = 3.0
SHARE_SUM_TOLERANCE = 0.15
# Risk thresholds on the interval width (% of |prediction|, floor 1).
RISK_HIGH_WIDTH = 80.0
RISK_MEDIUM_WIDTH = 40.0
# Optimisation-score weights: profit, commission, in-store share, growth.
SCORE_WEIGHTS = (40.0, 30.0, 20.0, 10.0)
# Commission sweep: 30 points from 0.27 to 0.33.
SWEEP_LO, SWEEP_HI, SWEEP_POINTS = 0.27, 0.33, 30
# Residual-quantile interval and quantile-model levels.
INTERVAL_PROBS = (0.025, 0.975)
QUANTILE_ALPHAS = {"lower": 0.025, "median": 0.5, "upper": 0.975}
# Recommendation cost targets (percent of revenue).
TARGET_COST_TO_REVENUE, TARGET_COGS, TARGET_OPEX = 70.0, 28.0, 40.0
KEEP_SAVED_SCENARIOS = 5
MODEL_ORDER = ["Linear Regression", "Random Forest", "Gradient Boosting", "Boosted Trees (deep)"]
REQUIRED_METRICS = ["CV_RMSE_mean", "CV_RMSE_std", "CV_R2_mean", "CV_R2_std",
                    "CV_MAE_mean", "CV_MAE_std", "residual_low", "residual_high"]
# Scenario defaults (the dashboard's initial slider positions).
DEFAULT_SCENARIO = dict(in_store=0.23, ue_share=0.49, dd_share=0.27, sd_share=0.25,
                        commission=0.30, delivery_cost=3.12, radius=10, growth=1.03,
                        aov=38.52, orders=1190, cogs=0.28, opex=0.41)

# ---------------------------------------------------------------------------
# Schemas
# ---------------------------------------------------------------------------
KEY_COLS = ["RestaurantID", "Yr", "Mo"]

OUTLET = T.StructType([
    T.StructField("RestaurantID", T.LongType()),
    T.StructField("RestaurantName", T.StringType()),
    T.StructField("Yr", T.IntegerType()),
    T.StructField("Mo", T.IntegerType()),
    T.StructField("CuisineType", T.StringType()),
    T.StructField("Segment", T.StringType()),
    T.StructField("Subregion", T.StringType()),
    T.StructField("MonthlyOrders", T.IntegerType()),
    T.StructField("InStoreShare", T.DoubleType()),
    T.StructField("UE_share", T.DoubleType()),
    T.StructField("DD_share", T.DoubleType()),
    T.StructField("SD_share", T.DoubleType()),
    T.StructField("InStoreRevenue", T.DoubleType()),
    T.StructField("UberEatsRevenue", T.DoubleType()),
    T.StructField("DoorDashRevenue", T.DoubleType()),
    T.StructField("SelfDeliveryRevenue", T.DoubleType()),
    T.StructField("AOV", T.DoubleType()),
    T.StructField("CommissionRate", T.DoubleType()),
    T.StructField("DeliveryCostPerOrder", T.DoubleType()),
    T.StructField("DeliveryRadiusKM", T.IntegerType()),
    T.StructField("GrowthFactor", T.DoubleType()),
    T.StructField("COGSRate", T.DoubleType()),
    T.StructField("OPEXRate", T.DoubleType()),
    T.StructField("SD_DeliveryTotalCost", T.DoubleType()),
    T.StructField("InStoreNetProfit", T.DoubleType()),
    T.StructField("UberEatsNetProfit", T.DoubleType()),
    T.StructField("DoorDashNetProfit", T.DoubleType()),
    T.StructField("SelfDeliveryNetProfit", T.DoubleType()),
])

REQUIRED_COLS = [f.name for f in OUTLET.fields if f.name not in ("Yr", "Mo")]

SCENARIO = T.StructType([
    T.StructField("scenario_id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("user", T.StringType()),
    T.StructField("in_store", T.DoubleType()),
    T.StructField("ue_share", T.DoubleType()),
    T.StructField("dd_share", T.DoubleType()),
    T.StructField("sd_share", T.DoubleType()),
    T.StructField("commission", T.DoubleType()),
    T.StructField("delivery_cost", T.DoubleType()),
    T.StructField("radius", T.IntegerType()),
    T.StructField("growth", T.DoubleType()),
    T.StructField("aov", T.DoubleType()),
    T.StructField("orders", T.IntegerType()),
    T.StructField("cogs", T.DoubleType()),
    T.StructField("opex", T.DoubleType()),
    T.StructField("cuisine", T.StringType()),
    T.StructField("segment", T.StringType()),
    T.StructField("subregion", T.StringType()),
    T.StructField("saved_at", T.TimestampType()),
])
SCENARIO_INPUTS = [f.name for f in SCENARIO.fields
                   if f.name not in ("scenario_id", "name", "user", "saved_at")]
