"""Schemas, code tables, the feature registry and the business constants.

Everything in this module has to hold exactly these values for results to be right, so it is
stated once, as plain text, and imported everywhere else.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# --- fixed values: raw input schemas ---------------------------------------------------------

RAW_SALES = T.StructType(
    [
        T.StructField("Store", T.IntegerType()),
        T.StructField("DayOfWeek", T.IntegerType()),
        T.StructField("Date", T.StringType()),
        T.StructField("Sales", T.DoubleType()),
        T.StructField("Customers", T.IntegerType()),
        T.StructField("Open", T.IntegerType()),
        T.StructField("Promo", T.IntegerType()),
        T.StructField("StateHoliday", T.StringType()),
        T.StructField("SchoolHoliday", T.IntegerType()),
    ]
)

RAW_STORES = T.StructType(
    [
        T.StructField("Store", T.IntegerType()),
        T.StructField("StoreType", T.StringType()),
        T.StructField("Assortment", T.StringType()),
        T.StructField("CompetitionDistance", T.DoubleType()),
        T.StructField("CompetitionOpenSinceMonth", T.IntegerType()),
        T.StructField("CompetitionOpenSinceYear", T.IntegerType()),
        T.StructField("Promo2", T.IntegerType()),
        T.StructField("Promo2SinceWeek", T.IntegerType()),
        T.StructField("Promo2SinceYear", T.IntegerType()),
        T.StructField("PromoInterval", T.StringType()),
    ]
)

INGEST_COLUMNS = [
    "ingestion_timestamp",
    "source_file_path",
    "source_system",
    "ingestion_batch_id",
    "record_source",
    "is_deleted",
    "row_hash",
]

# --- fixed values: cleaning ------------------------------------------------------------------

SALES_TYPES = {
    "Store": "int",
    "DayOfWeek": "int",
    "Sales": "double",
    "Customers": "int",
    "Open": "int",
    "Promo": "int",
    "SchoolHoliday": "int",
}
EXPECTED_TYPES = {"Store": "int", "Date": "date", "Sales": "double", "Customers": "int"}
CRITICAL_SALES_COLUMNS = ["Store", "Date", "Sales", "DayOfWeek"]
SALES_KEY = ["Store", "Date"]
BATCH_COLUMN = "run_batch"  # of the logs: which run and step a row comes from
DATE_FORMAT = "yyyy-MM-dd"
HOLIDAY_CODES = {"0": "None", "a": "Public", "b": "Easter", "c": "Christmas"}
OUTLIER_QUANTILE = 0.99
RULES_VERSION = "v1.0"

NO_COMPETITION = 999999.0
COMPETITION_FILL = {
    "CompetitionDistance": NO_COMPETITION,
    "CompetitionOpenSinceMonth": 0,
    "CompetitionOpenSinceYear": 0,
}
PROMO2_FILL = {"Promo2": 0, "Promo2SinceWeek": 0, "Promo2SinceYear": 0, "PromoInterval": "None"}
PROXIMITY_BELOW = [
    (1000, "Very Close"),
    (5000, "Close"),
    (10000, "Moderate"),
    (999999, "Far"),
]

# --- fixed values: features ------------------------------------------------------------------

SALES_LAGS = [1, 7, 14, 21, 30, 60, 90, 365]
CUSTOMER_LAGS = [7, 30]
MEAN_WINDOWS = [7, 14, 30, 60, 90]
STD_WINDOWS = [7, 30, 90]
GROWTH_LAGS = [7, 30, 365]
CYCLES = {"day_of_week": 7, "month": 12, "day": 31}
TREND_UP, TREND_DOWN = 1.1, 0.9
PRESSURE_BELOW = [(500, 5), (1000, 4), (3000, 3), (10000, 2), (999999, 1)]
TIER_ABOVE = [(8000, "High"), (5000, "Medium")]
ASSORTMENT_SCORES = {"A": 1, "B": 2, "C": 3}
STORE_TYPE_SCORES = {"A": 1, "B": 2, "C": 3, "D": 4}
STOCKOUT_SALES_BELOW, STOCKOUT_CUSTOMERS_ABOVE = 100, 50
WARMUP_COLUMNS = ["sales_lag_7", "sales_lag_30", "rolling_mean_7", "rolling_mean_30"]
FEATURE_VERSION = "v1.0"

FEATURE_CATEGORIES = {
    "Temporal Features": [
        "year", "month", "day", "day_of_week", "week_of_year", "quarter",
        "is_weekend", "is_month_start", "is_month_end", "days_in_month",
        "season", "season_num",
    ],
    "Lag Features": [
        "sales_lag_1", "sales_lag_7", "sales_lag_14", "sales_lag_21",
        "sales_lag_30", "sales_lag_60", "sales_lag_90", "sales_lag_365",
        "customers_lag_7", "customers_lag_30",
    ],
    "Rolling Window Features": [
        "rolling_mean_7", "rolling_mean_14", "rolling_mean_30", "rolling_mean_60",
        "rolling_mean_90", "rolling_std_7", "rolling_std_30", "rolling_std_90",
        "rolling_min_30", "rolling_max_30", "rolling_median_30", "rolling_customers_mean_30",
    ],
    "Growth & Trend Features": [
        "sales_growth_7d", "sales_growth_30d", "sales_growth_365d",
        "demand_volatility", "sales_momentum", "trend_direction",
    ],
    "Cyclic Encoding Features": [
        "day_of_week_sin", "day_of_week_cos", "month_sin", "month_cos", "day_sin", "day_cos",
    ],
    "Supply Chain Domain Features": [
        "competition_pressure", "avg_sales_per_store", "store_performance_tier",
        "sales_per_customer", "promo_effectiveness", "promo_frequency_30d",
        "potential_stockout", "holiday_sales_multiplier", "assortment_score", "store_type_score",
    ],
    "Original Store Features": [
        "StoreType", "Assortment", "CompetitionDistance", "Promo2",
        "has_competition", "competition_proximity",
    ],
    "Original Sales Features": [
        "Open", "Promo", "StateHoliday", "SchoolHoliday", "is_holiday", "is_promo_day",
    ],
}
CATEGORICAL_FEATURES = [
    "StoreType", "Assortment", "StateHoliday", "season", "trend_direction",
    "promo_effectiveness", "store_performance_tier", "competition_proximity",
]

# --- fixed values: model inputs --------------------------------------------------------------

REFERENCE_FEATURES = [
    "sales_lag_7", "sales_lag_14", "sales_lag_30", "sales_lag_60", "sales_lag_90",
    "rolling_mean_7", "rolling_mean_30", "rolling_mean_60", "rolling_std_7", "rolling_std_30",
    "sales_growth_7d", "sales_growth_30d", "demand_volatility", "sales_momentum",
    "day_of_week", "month", "quarter", "is_weekend", "is_month_start", "is_month_end",
    "day_of_week_sin", "day_of_week_cos", "month_sin", "month_cos",
    "competition_pressure", "sales_per_customer", "promo_frequency_30d",
    "assortment_score", "store_type_score",
    "is_holiday", "is_promo_day", "Promo2", "has_competition",
]
# These three are computed from the very Sales value a model is asked to predict.
LEAKY_FEATURES = ["sales_growth_7d", "sales_growth_30d", "sales_per_customer"]
SAFE_FEATURES = [f for f in REFERENCE_FEATURES if f not in LEAKY_FEATURES]
# Known thirty rows ahead: calendar, store attributes, planned flags and lags of 30 rows or more.
HORIZON_FEATURES = [
    "sales_lag_30", "sales_lag_60", "sales_lag_90",
    "day_of_week", "month", "quarter", "is_weekend", "is_month_start", "is_month_end",
    "day_of_week_sin", "day_of_week_cos", "month_sin", "month_cos", "day_sin", "day_cos",
    "competition_pressure", "assortment_score", "store_type_score",
    "is_holiday", "is_promo_day", "Promo2", "has_competition",
]
CORRELATED_FEATURES = [
    "sales_lag_7", "sales_lag_30", "rolling_mean_30", "demand_volatility",
    "sales_momentum", "sales_per_customer", "competition_pressure", "promo_frequency_30d",
]
CRITICAL_FEATURES = [
    "Sales", "sales_lag_7", "sales_lag_30", "rolling_mean_30",
    "demand_volatility", "sales_momentum",
]
RANGED_FEATURES = ["demand_volatility", "sales_momentum", "competition_pressure"]
# Suffixes of the prediction columns, under the names that dashboards read.
MODEL_COLUMNS = {"Linear Regression": "lr", "Random Forest": "rf", "Boosted Trees": "boosted"}
PRIMARY_MODEL = "boosted"
MAPE_TARGET = 15.0

FOREST_PARAMS = {
    "numTrees": 100, "maxDepth": 15, "minInstancesPerNode": 5,
    "featureSubsetStrategy": "all", "seed": 42,
}
BOOSTED_PARAMS = {
    "maxIter": 150, "maxDepth": 10, "stepSize": 0.1, "subsamplingRate": 0.8,
    "featureSubsetStrategy": "0.8", "minInstancesPerNode": 3, "minInfoGain": 0.1, "seed": 42,
}
# Small models that SQL can fit alike: inputs of few values, every row and input for every tree, and
# nodes so large that no two inputs split them alike.
CHECKED_FEATURES = ["day_of_week", "month", "competition_pressure", "is_holiday", "is_promo_day"]
CHECKED_FOREST = {
    "numTrees": 1, "maxDepth": 5, "bootstrap": False, "minInstancesPerNode": 50, "maxBins": 256,
}
CHECKED_BOOSTED = {
    "maxIter": 3, "maxDepth": 4, "subsamplingRate": 1.0, "featureSubsetStrategy": "all",
    "minInstancesPerNode": 50, "maxBins": 256,
}
LINEAR_PARAMS = {"regParam": 0.0, "solver": "normal"}

# --- fixed values: inventory -----------------------------------------------------------------

FORECAST_ROWS = 30
ACTIONS = {
    "high": "URGENT: Place order immediately",
    "low": "WARNING: Below safety stock",
    "excess": "EXCESS: Reduce inventory",
    "normal": "NORMAL: Monitor",
    "unknown": "UNKNOWN: No forecast or no stock",
}


@dataclass(frozen=True)
class InventoryPolicy:
    """Business constants of the replenishment rules."""

    service_level: float = 0.95
    lead_time_days: int = 7
    holding_cost_per_month: float = 2.50
    stockout_cost: float = 50.0
    order_cost: float = 100.0
    stockout_rate_today: float = 0.15
    policy_days_today: int = 45


LAYERS = {
    "bronze": "Raw data as it was loaded",
    "silver": "Cleaned and checked data",
    "gold": "Features and aggregates for the business",
    "ml": "Models, predictions and recommendations",
    "analytics": "Tables and views for dashboards",
}
