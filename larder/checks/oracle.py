"""The same results as ``spark_queries`` in DuckDB's SQL, written independently of Spark.

``CTES`` holds named sub-queries in order of dependence; a statement is prefixed with those it
needs. ``ROUND(x, n) + 0.0`` mirrors ``spark_queries.rounded``.
"""

from __future__ import annotations

import re
from statistics import NormalDist

from larder import params as P
from larder.checks import model_sql

CTES: dict[str, str] = {}
SQL: dict[str, str] = {}


def r(expression: str, digits: int = 4, name: str | None = None) -> str:
    return f"ROUND({expression}, {digits}) + 0.0 AS {name or expression}"


def in_list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def strays(source: str) -> str:
    return f"""SELECT * FROM {source}
UNION ALL SELECT * REPLACE (-Store AS Store) FROM {source} WHERE day(Date) = 1"""


CTES["panel"] = """
SELECT CAST(l_suppkey AS INTEGER) AS Store, CAST(l_shipdate AS DATE) AS Date,
       CAST(SUM(CAST(ROUND(l_extendedprice) AS BIGINT)) AS DOUBLE) / 8 AS Sales,
       CAST(SUM(CAST(l_quantity AS BIGINT)) AS INTEGER) AS Customers,
       MAX(CASE WHEN l_discount >= 0.08 THEN 1 ELSE 0 END) AS Promo
FROM lineitem GROUP BY 1, 2"""

CTES["coded"] = """
SELECT *, Store * 31 + year(Date) * 372 + month(Date) * 31 + day(Date) AS h FROM panel"""

CTES["faulty"] = """
SELECT Store, CAST(isodow(Date) AS INTEGER) AS DayOfWeek, Date,
       CASE WHEN h % 211 = 0 THEN NULL WHEN h % 223 = 0 THEN -Sales WHEN h % 97 = 0 THEN 0.0
            ELSE Sales END AS Sales,
       CASE WHEN h % 97 = 0 THEN 0 ELSE Customers END AS Customers,
       CAST(CASE WHEN h % 97 = 0 OR h % 227 = 0 THEN 0 WHEN h % 229 = 0 THEN NULL ELSE 1 END
            AS INTEGER) AS Open,
       Promo,
       CASE WHEN month(Date) = 12 AND day(Date) IN (25, 26) THEN 'c'
            WHEN month(Date) = 4 AND day(Date) <= 4 THEN 'b'
            WHEN month(Date) IN (1, 5, 10) AND day(Date) = 1 THEN 'a' ELSE '0' END AS StateHoliday,
       CASE WHEN month(Date) IN (7, 8) THEN 1 ELSE 0 END AS SchoolHoliday,
       h
FROM coded"""

CTES["raw_sales"] = """
SELECT * EXCLUDE (h) FROM faulty
UNION ALL SELECT * EXCLUDE (h) FROM faulty WHERE h % 101 = 0"""

CTES["raw_stores"] = """
SELECT CAST(s_suppkey AS INTEGER) AS Store,
       ' ' || substr('abcd', s_nationkey % 4 + 1, 1) AS StoreType,
       substr('abc', s_suppkey % 3 + 1, 1) AS Assortment,
       CASE WHEN s_suppkey % 10 = 7 THEN NULL
            ELSE CAST((s_suppkey * 1370) % 15000 + 50 AS DOUBLE) END AS CompetitionDistance,
       CASE WHEN s_suppkey % 10 IN (3, 7) THEN NULL
            ELSE CAST(s_suppkey % 12 + 1 AS INTEGER) END AS CompetitionOpenSinceMonth,
       CASE WHEN s_suppkey % 10 IN (3, 7) THEN NULL
            ELSE CAST(1990 + s_suppkey % 9 AS INTEGER) END AS CompetitionOpenSinceYear,
       CAST(s_suppkey % 2 AS INTEGER) AS Promo2,
       CASE WHEN s_suppkey % 2 = 1 THEN CAST(s_suppkey % 52 + 1 AS INTEGER) END AS Promo2SinceWeek,
       CASE WHEN s_suppkey % 2 = 1 THEN CAST(1996 + s_suppkey % 4 AS INTEGER) END AS Promo2SinceYear,
       CASE WHEN s_suppkey % 2 = 1 THEN 'Jan,Apr,Jul,Oct' END AS PromoInterval
FROM supplier"""

CTES["kept"] = """
SELECT DISTINCT * FROM raw_sales
WHERE NOT (Open = 0 AND Sales > 0) AND Sales >= 0
  AND Store IS NOT NULL AND Date IS NOT NULL AND DayOfWeek IS NOT NULL"""

DECODED = """CASE StateHoliday WHEN '0' THEN 'None' WHEN 'a' THEN 'Public' WHEN 'b' THEN 'Easter'
     WHEN 'c' THEN 'Christmas' ELSE StateHoliday END"""

FLAGS = f"""
CASE WHEN {DECODED} <> 'None' OR SchoolHoliday = 1 THEN 1 ELSE 0 END AS is_holiday,
Promo AS is_promo_day, Open AS is_open,
CASE WHEN Customers > 0 THEN 1 ELSE 0 END AS has_customers"""

CTES["silver_sales"] = f"""
SELECT * REPLACE ({DECODED} AS StateHoliday), {FLAGS} FROM kept"""

CTES["gapped_stores"] = """
SELECT * FROM raw_stores UNION ALL SELECT * REPLACE (CAST(NULL AS INTEGER) AS Store) FROM raw_stores"""

PROXIMITY = """CASE WHEN CompetitionDistance < 1000 THEN 'Very Close'
     WHEN CompetitionDistance < 5000 THEN 'Close' WHEN CompetitionDistance < 10000 THEN 'Moderate'
     WHEN CompetitionDistance < 999999 THEN 'Far' ELSE 'None' END"""

PRESSURE = """CASE WHEN CompetitionDistance < 500 THEN 5 WHEN CompetitionDistance < 1000 THEN 4
     WHEN CompetitionDistance < 3000 THEN 3 WHEN CompetitionDistance < 10000 THEN 2
     WHEN CompetitionDistance < 999999 THEN 1 ELSE 0 END"""

STAMP = """'silver' AS data_quality_layer, 'cleaned' AS data_quality_status,
       'v1.0' AS cleaning_rules_version"""


def cleaned_stores(source: str) -> str:
    return f"""
SELECT Store, upper(trim(StoreType)) AS StoreType, upper(trim(Assortment)) AS Assortment,
       COALESCE(CompetitionDistance, 999999) AS CompetitionDistance,
       COALESCE(CompetitionOpenSinceMonth, 0) AS CompetitionOpenSinceMonth,
       COALESCE(CompetitionOpenSinceYear, 0) AS CompetitionOpenSinceYear,
       COALESCE(Promo2, 0) AS Promo2, COALESCE(Promo2SinceWeek, 0) AS Promo2SinceWeek,
       COALESCE(Promo2SinceYear, 0) AS Promo2SinceYear,
       COALESCE(PromoInterval, 'None') AS PromoInterval,
       CASE WHEN CompetitionDistance IS NULL THEN 0 ELSE 1 END AS has_competition,
       CASE WHEN Promo2 = 1 THEN 1 ELSE 0 END AS in_promo2,
       CompetitionDistance / 1000 AS competition_distance_km,
       upper(trim(StoreType)) || '-' || upper(trim(Assortment)) AS store_category,
       {PROXIMITY} AS competition_proximity,
       {STAMP}
FROM {source} WHERE Store IS NOT NULL"""


CTES["silver_stores"] = cleaned_stores("raw_stores")

BY_STORE = "PARTITION BY Store ORDER BY Date"


def before(k: int) -> str:
    return f"OVER ({BY_STORE} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"


def lags(column: str, ks) -> str:
    return ", ".join(
        f"LAG({column}, {k}) OVER ({BY_STORE}) AS {column.lower()}_lag_{k}" for k in ks
    )


ROLLING = ",\n".join(
    [f"AVG(Sales) {before(k)} AS rolling_mean_{k}" for k in P.MEAN_WINDOWS]
    + [f"STDDEV_SAMP(Sales) {before(k)} AS rolling_std_{k}" for k in P.STD_WINDOWS]
    + [
        f"MIN(Sales) {before(30)} AS rolling_min_30",
        f"MAX(Sales) {before(30)} AS rolling_max_30",
        f"QUANTILE_DISC(Sales, 0.5) {before(30)} AS rolling_median_30",
        f"AVG(Customers) {before(30)} AS rolling_customers_mean_30",
        f"AVG(Promo) {before(30)} AS promo_frequency_30d",
    ]
)

CTES["rolled"] = f"""
SELECT *, {lags('Sales', P.SALES_LAGS)}, {lags('Customers', P.CUSTOMER_LAGS)},
{ROLLING},
AVG(Sales) OVER (PARTITION BY Store) AS avg_sales_per_store
FROM silver_sales"""


def growth(k: int) -> str:
    return (
        f"CASE WHEN sales_lag_{k} > 0 THEN (Sales - sales_lag_{k}) / sales_lag_{k} * 100"
        f" ELSE 0 END"
    )


VOLATILITY = "CASE WHEN rolling_mean_30 > 0 THEN rolling_std_30 / rolling_mean_30 ELSE 0 END"
MOMENTUM = """CASE WHEN rolling_mean_7 > 0 AND rolling_mean_30 > 0
     THEN rolling_mean_7 / rolling_mean_30 ELSE 1 END"""
TREND = f"""CASE WHEN {MOMENTUM} > 1.1 THEN 'Increasing' WHEN {MOMENTUM} < 0.9 THEN 'Decreasing'
     ELSE 'Stable' END"""
TIER = """CASE WHEN avg_sales_per_store > 8000 THEN 'High' WHEN avg_sales_per_store > 5000
     THEN 'Medium' ELSE 'Low' END"""
PER_CUSTOMER = "CASE WHEN Customers > 0 THEN Sales / Customers ELSE 0 END"
PROMO_LABEL = """CASE WHEN Promo = 1 AND Sales > rolling_mean_30 THEN 'Effective'
     WHEN Promo = 1 AND Sales <= rolling_mean_30 THEN 'Ineffective' ELSE 'No Promo' END"""
MULTIPLIER = """CASE WHEN is_holiday = 1 AND rolling_mean_30 > 0 THEN Sales / rolling_mean_30
     ELSE 1 END"""
ASSORTMENT_SCORE = "CASE Assortment WHEN 'A' THEN 1 WHEN 'B' THEN 2 WHEN 'C' THEN 3 ELSE 1 END"
TYPE_SCORE = """CASE StoreType WHEN 'A' THEN 1 WHEN 'B' THEN 2 WHEN 'C' THEN 3 WHEN 'D' THEN 4
     ELSE 1 END"""

CALENDAR = {
    "year": "CAST(year(Date) AS INTEGER)",
    "month": "CAST(month(Date) AS INTEGER)",
    "day": "CAST(day(Date) AS INTEGER)",
    "day_of_week": "CAST(dayofweek(Date) + 1 AS INTEGER)",
    "week_of_year": "CAST(weekofyear(Date) AS INTEGER)",
    "quarter": "CAST(quarter(Date) AS INTEGER)",
    "is_weekend": "CASE WHEN dayofweek(Date) IN (0, 6) THEN 1 ELSE 0 END",
    "is_month_start": "CASE WHEN day(Date) <= 7 THEN 1 ELSE 0 END",
    "is_month_end": "CASE WHEN day(Date) >= 25 THEN 1 ELSE 0 END",
    "days_in_month": "CAST(day(last_day(Date)) AS INTEGER)",
    "season": """CASE WHEN month(Date) IN (3, 4, 5) THEN 'Spring'
     WHEN month(Date) IN (6, 7, 8) THEN 'Summer'
     WHEN month(Date) IN (9, 10, 11) THEN 'Fall' ELSE 'Winter' END""",
    "season_num": """CASE WHEN month(Date) IN (3, 4, 5) THEN 1 WHEN month(Date) IN (6, 7, 8) THEN 2
     WHEN month(Date) IN (9, 10, 11) THEN 3 ELSE 4 END""",
}


def calendar(*names: str) -> str:
    return ",\n".join(f"{CALENDAR[n]} AS {n}" for n in names or CALENDAR)


CYCLIC = {
    "day_of_week": ("dayofweek(Date) + 1", 7),
    "month": ("month(Date)", 12),
    "day": ("day(Date)", 31),
}
WAVES = ",\n".join(
    f"{f}(({x}) * (2 * pi() / {period})) AS {name}_{f}"
    for name, (x, period) in CYCLIC.items()
    for f in ("sin", "cos")
)

CTES["gold"] = f"""
SELECT r.*, {calendar()}, {WAVES},
{growth(7)} AS sales_growth_7d, {growth(30)} AS sales_growth_30d, {growth(365)} AS sales_growth_365d,
{VOLATILITY} AS demand_volatility, {MOMENTUM} AS sales_momentum, {TREND} AS trend_direction,
{TIER} AS store_performance_tier, {PER_CUSTOMER} AS sales_per_customer,
{PROMO_LABEL} AS promo_effectiveness,
CASE WHEN Open = 1 AND Sales < 100 AND Customers > 50 THEN 1 ELSE 0 END AS potential_stockout,
{MULTIPLIER} AS holiday_sales_multiplier,
{PRESSURE} AS competition_pressure, {ASSORTMENT_SCORE} AS assortment_score,
{TYPE_SCORE} AS store_type_score,
s.* EXCLUDE (Store)
FROM rolled r LEFT JOIN silver_stores s ON r.Store = s.Store
WHERE sales_lag_7 IS NOT NULL AND sales_lag_30 IS NOT NULL
  AND rolling_mean_7 IS NOT NULL AND rolling_mean_30 IS NOT NULL"""


def cut_of(table: str) -> str:
    return f"""
SELECT MIN(Date) AS cut FROM (
    SELECT Date, SUM(COUNT(*)) OVER (ORDER BY Date) AS upto,
           SUM(COUNT(*)) OVER () AS total
    FROM {table} GROUP BY Date) WHERE upto > FLOOR(total * 0.8)"""


CTES["gold_cut"] = cut_of("gold")

CTES["pred"] = """
SELECT *, actual_sales - predicted_sales_lag30 AS error_lag30,
       ABS(actual_sales - predicted_sales_lag30) AS absolute_error_lag30,
       ABS(actual_sales - predicted_sales_lag30) / NULLIF(actual_sales, 0) * 100
           AS percentage_error_lag30
FROM (SELECT Store, Date, Sales AS actual_sales, sales_lag_30 AS predicted_sales_lag30,
             sales_lag_60 AS predicted_sales_lag60, sales_lag_90 AS predicted_sales_lag90
      FROM gold WHERE Date >= (SELECT cut FROM gold_cut))"""

CTES["enriched"] = """
SELECT p.*, g.demand_volatility, g.rolling_std_30
FROM pred p LEFT JOIN gold g ON p.Store = g.Store AND p.Date = g.Date"""

CTES["ahead"] = f"""
SELECT *, SUM(predicted_sales_lag30) OVER w AS forecast_30d,
       AVG(demand_volatility) OVER w AS avg_volatility_30d, COUNT(*) OVER w AS horizon_rows
FROM enriched
WINDOW w AS ({BY_STORE} ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING)"""


def latest(rows: int) -> str:
    full = f"FILTER (WHERE horizon_rows >= {rows})"
    return f"""
SELECT Store, MAX(Date) {full} AS latest_date,
       arg_max(forecast_30d, Date) {full} AS forecast_next_30d,
       arg_max(avg_volatility_30d, Date) {full} AS demand_volatility_30d,
       AVG(actual_sales) AS avg_actual_sales
FROM ahead GROUP BY Store"""


CTES["latest_full"] = latest(30)

CTES["stocked"] = """
SELECT *, (Store * 37 + 11) % 61 * forecast_next_30d / 30 AS current_inventory FROM latest_full"""

# Fixed value: standard normal quantile at 0.95.
Z95 = "1.6448536269514722"

CTES["levels"] = f"""
SELECT *, forecast_next_30d / 30 AS avg_daily_demand,
       forecast_next_30d / 30 * demand_volatility_30d AS demand_std,
       GREATEST(0, {Z95} * forecast_next_30d / 30 * demand_volatility_30d * sqrt(7)) AS safety_stock,
       sqrt(2 * forecast_next_30d * 12 * 100 / 30.0) AS lot
FROM stocked"""

CTES["plan"] = """
SELECT Store, latest_date, forecast_next_30d, demand_volatility_30d AS demand_volatility,
       current_inventory, avg_daily_demand, demand_std, safety_stock,
       GREATEST(0, avg_daily_demand * 7 + safety_stock) AS reorder_point,
       forecast_next_30d AS optimal_order_qty,
       CASE WHEN forecast_next_30d <= 0 THEN forecast_next_30d ELSE GREATEST(1, lot) END
           AS economic_order_qty,
       CASE WHEN current_inventory IS NULL THEN 'UNKNOWN'
            WHEN current_inventory < GREATEST(0, avg_daily_demand * 7 + safety_stock) THEN 'HIGH'
            ELSE 'LOW' END AS stockout_risk,
       CASE WHEN avg_daily_demand > 0 THEN current_inventory / avg_daily_demand
            WHEN current_inventory IS NOT NULL THEN 999 END AS days_until_stockout,
       95.0::DOUBLE AS service_level
FROM levels"""

ACTION = """CASE WHEN stockout_risk = 'HIGH' THEN 'URGENT: Place order immediately'
     WHEN current_inventory < safety_stock THEN 'WARNING: Below safety stock'
     WHEN current_inventory > optimal_order_qty * 2 THEN 'EXCESS: Reduce inventory'
     ELSE 'NORMAL: Monitor' END"""
PRIORITY = """CASE WHEN stockout_risk = 'HIGH' THEN 1 WHEN current_inventory < safety_stock THEN 2
     WHEN current_inventory < reorder_point THEN 3 ELSE 4 END"""
GRADED = """CASE WHEN days_until_stockout < 7 THEN 1 WHEN current_inventory < safety_stock THEN 2
     WHEN current_inventory < reorder_point THEN 3 ELSE 4 END"""
EXCESS = """CASE WHEN current_inventory > optimal_order_qty * 2
     THEN current_inventory - optimal_order_qty ELSE 0 END"""

CTES["recs"] = f"""
SELECT *, {ACTION} AS recommended_action, {PRIORITY} AS order_priority,
       reorder_point - current_inventory AS inventory_gap, {EXCESS} AS excess_inventory
FROM plan"""

# Sums of thirtieths of eighths end in at most five decimals: rounded there, they are exact.
CTES["exact_recs"] = f"""
SELECT * REPLACE ({", ".join(r(c, 5) for c in (
    "forecast_next_30d", "current_inventory", "reorder_point", "optimal_order_qty",
    "days_until_stockout"))})
FROM recs"""

CTES["totals"] = """
SELECT COUNT(Store) AS total_stores, SUM(forecast_next_30d) AS total_forecasted_demand,
       SUM(current_inventory) AS total_current_inventory,
       SUM(optimal_order_qty) AS total_optimal_inventory, SUM(safety_stock) AS total_safety_stock,
       COUNT(*) FILTER (WHERE stockout_risk = 'HIGH') AS high_risk_stores,
       COUNT(*) FILTER (WHERE stockout_risk = 'UNKNOWN') AS unknown_stores,
       SUM(excess_inventory) AS total_excess_inventory
FROM recs"""

CTES["impact"] = """
SELECT total_stores, total_forecasted_demand AS forecasted_demand_30d,
       total_current_inventory AS current_inventory, total_optimal_inventory AS optimal_inventory,
       total_current_inventory - total_optimal_inventory AS inventory_reduction_units,
       (total_current_inventory - total_optimal_inventory) / total_current_inventory * 100
           AS inventory_reduction_pct,
       (total_current_inventory - total_optimal_inventory) * 2.5 AS monthly_holding_cost_savings,
       (total_current_inventory - total_optimal_inventory) * 2.5 * 12 AS annual_holding_cost_savings,
       high_risk_stores, unknown_stores,
       0.1 * total_forecasted_demand AS stockouts_prevented,
       0.1 * total_forecasted_demand * 50 AS stockout_cost_savings,
       (total_current_inventory - total_optimal_inventory) * 2.5 * 12
           + 0.1 * total_forecasted_demand * 50 AS total_annual_roi,
       95.0::DOUBLE AS service_level_target, CAST(7 AS BIGINT) AS lead_time_days
FROM totals"""


def measures(predicted: str) -> str:
    e = f"(actual_sales - {predicted})"
    return f"""AVG(ABS({e})) AS MAE, SQRT(AVG({e} * {e})) AS RMSE,
1 - SUM({e} * {e}) / NULLIF(VAR_POP(actual_sales) * COUNT(*), 0) AS R_square,
AVG(ABS({e}) / NULLIF(ABS(actual_sales), 0)) * 100 AS MAPE_percent"""


ROUNDED_MEASURES = ", ".join(r(m) for m in ("MAE", "RMSE", "R_square", "MAPE_percent"))

CTES["compared"] = " UNION ALL ".join(
    f"SELECT '{model}' AS Model, {measures(column)} FROM pred"
    for model, column in {
        "30-row lag": "predicted_sales_lag30",
        "60-row lag": "predicted_sales_lag60",
        "90-row lag": "predicted_sales_lag90",
    }.items()
)

CTES["panel_rolled"] = f"""
SELECT *, LAG(Sales, 7) OVER ({BY_STORE}) AS sales_lag_7,
       LAG(Sales, 30) OVER ({BY_STORE}) AS sales_lag_30,
       AVG(Sales) {before(7)} AS rolling_mean_7, AVG(Sales) {before(30)} AS rolling_mean_30
FROM panel"""

CTES["correlations"] = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CORR(Sales, {c}) AS c FROM gold" for c in P.CORRELATED_FEATURES
)

CTES["demand"] = """
SELECT Store, AVG(Sales) AS daily, STDDEV_SAMP(Sales) AS sigma FROM panel GROUP BY Store"""

CTES["fitted"] = """
SELECT regr_slope(Sales, rolling_mean_30) AS slope,
       regr_intercept(Sales, rolling_mean_30) AS intercept
FROM gold WHERE Date < (SELECT cut FROM gold_cut)"""

# Models that SQL can fit as well: least squares on all inputs, and trees on inputs of few values.
RECURSIVE = set()
for name, inputs in {"safe": P.SAFE_FEATURES, "horizon": P.HORIZON_FEATURES}.items():
    CTES[f"{name}_rows"] = f"""
SELECT Store, Date, CAST(Sales AS DOUBLE) AS y, [{model_sql.values(inputs)}] AS x,
       Date < (SELECT cut FROM gold_cut) AS learn
FROM gold"""
    CTES |= model_sql.least_squares(f"{name}_squares", f"{name}_rows", inputs)
    RECURSIVE.add(f"{name}_squares_steps")
CTES["tree_inputs"] = f"""
SELECT Store, Date, CAST(Sales AS DOUBLE) AS y, CAST(Sales AS DOUBLE) AS goal,
       [{model_sql.values(P.CHECKED_FEATURES)}] AS x, Date < (SELECT cut FROM gold_cut) AS learn
FROM gold"""
CTES |= model_sql.tree(
    "one_tree", "tree_inputs", P.CHECKED_FOREST["maxDepth"],
    P.CHECKED_FOREST["minInstancesPerNode"], 0.0,
)
CTES["boosted_inputs"] = "SELECT * EXCLUDE (goal) FROM tree_inputs"
CTES |= model_sql.boosted(
    "three_trees", "boosted_inputs", P.CHECKED_BOOSTED["maxIter"], P.BOOSTED_PARAMS["stepSize"],
    P.CHECKED_BOOSTED["maxDepth"], P.CHECKED_BOOSTED["minInstancesPerNode"],
    P.BOOSTED_PARAMS["minInfoGain"],
)

# --- sources, sinks, catalog -----------------------------------------------------------------

SQL["scan_csv"] = "SELECT * FROM raw_sales"
SQL["scan_rejected"] = """
SELECT CAST(Store AS VARCHAR) || ',oops' AS record, 1 AS fields_read FROM raw_stores"""
SQL["scan_format_guard"] = """
SELECT f AS table_name, (SELECT COUNT(*) FROM raw_sales) AS record_count
FROM (VALUES ('csv'), ('json'), ('parquet')) t(f)"""
SQL["scan_table"] = "SELECT * FROM panel"
HASHED = "Store, DayOfWeek, Date, Sales, Customers, Open, Promo, StateHoliday, SchoolHoliday"
SQL["bronze_ingest"] = f"""
SELECT *, 'sales.csv' AS source_file_path, 'shop' AS source_system,
       '20240101_000000' AS ingestion_batch_id, 'daily sales' AS record_source,
       false AS is_deleted, sha256(concat_ws('||', {HASHED})) AS row_hash
FROM raw_sales"""
SQL["row_hash"] = f"""
SELECT Store, Date, sha256(concat_ws('||', {HASHED})) AS row_hash,
       sha256(concat_ws('||', {", ".join(
           f"COALESCE(CAST({c} AS VARCHAR), '<null>')" for c in HASHED.split(", "))}))
           AS row_hash_with_nulls
FROM raw_sales"""
SQL["sink_overwrite"] = "SELECT * FROM panel"
SQL["sink_append"] = """
SELECT Store, COUNT(*) AS days, 'first' AS batch FROM panel GROUP BY Store
UNION ALL SELECT Store, COUNT(*), 'second' FROM panel GROUP BY Store"""
SQL["lineage_record"] = """
SELECT t AS table_name, f AS full_table_name, s AS source_file, 'raw/' AS source_path,
       n AS record_count, '2024-01-01 00:00:00' AS load_timestamp, 'initial_load' AS load_type,
       'SUCCESS' AS status
FROM (SELECT 'bronze_raw_sales' t, 'bronze.raw_sales' f, 'sales.csv' s, COUNT(*) n FROM raw_sales
      UNION ALL
      SELECT 'bronze_raw_stores', 'bronze.raw_stores', 'stores.csv', COUNT(*) FROM raw_stores)"""
SQL["table_properties"] = """
SELECT key, value, (SELECT COUNT(*) FROM panel) AS record_count
FROM (VALUES ('quality.layer', 'bronze'), ('feature.version', 'v1.0')) t(key, value)"""
SQL["table_comment"] = """
SELECT 'Sales per store and day, the owner''s copy' AS comment, COUNT(*) AS record_count FROM panel"""
SQL["compact_table"] = "SELECT *, TRUE AS fewer_files, TRUE AS one_file_a_bucket FROM panel"
SQL["table_stats"] = "SELECT COUNT(*) AS row_count FROM panel"
SQL["layer_schemas"] = """
SELECT n AS namespace,
       CASE WHEN n = 'silver' THEN (SELECT COUNT(*) FROM panel) ELSE 0 END AS record_count
FROM (VALUES ('bronze'), ('silver'), ('gold'), ('ml'), ('analytics')) t(n)"""
SQL["create_view"] = """
SELECT Store, COUNT(*) AS days, SUM(Sales) AS sales FROM panel GROUP BY Store"""
SQL["literal_table"] = """
SELECT 'rows' AS metric, CAST(COUNT(*) AS VARCHAR) AS value FROM panel
UNION ALL SELECT 'sales', CAST(CAST(FLOOR(SUM(Sales)) AS BIGINT) AS VARCHAR) FROM panel"""
SQL["preview"] = "SELECT * FROM panel ORDER BY Store, Date LIMIT 10"

# --- profiling and data quality --------------------------------------------------------------

SQL["profile_summary"] = """
SELECT 'Total Sales Records' AS metric, CAST(COUNT(*) AS VARCHAR) AS value FROM raw_sales
UNION ALL SELECT 'Total Stores', CAST(COUNT(*) AS VARCHAR) FROM raw_stores
UNION ALL SELECT 'Unique Stores in Sales', CAST(COUNT(DISTINCT Store) AS VARCHAR) FROM raw_sales
UNION ALL SELECT 'Date Range Start', CAST(MIN(Date) AS VARCHAR) FROM raw_sales
UNION ALL SELECT 'Date Range End', CAST(MAX(Date) AS VARCHAR) FROM raw_sales
UNION ALL SELECT 'Total Days', CAST(COUNT(DISTINCT Date) AS VARCHAR) FROM raw_sales
UNION ALL SELECT 'Max Daily Sales', CAST(MAX(Sales) AS VARCHAR) FROM raw_sales"""
SQL["row_count_union"] = """
SELECT 'Sales' AS table_name, COUNT(*) AS record_count FROM raw_sales
UNION ALL SELECT 'Stores', COUNT(*) FROM raw_stores"""
SQL["null_profile"] = "SELECT " + ", ".join(
    f"COUNT(*) - COUNT({c}) AS {c}" for c in HASHED.split(", ")
) + " FROM raw_sales"
SQL["describe_stats"] = " UNION ALL ".join(
    f"""SELECT '{c}' AS column, COUNT({c}) AS count, {r(f"AVG({c})", name="mean")},
{r(f"STDDEV_SAMP({c})", name="stddev")}, {r(f"CAST(MIN({c}) AS DOUBLE)", name="min")},
{r(f"CAST(MAX({c}) AS DOUBLE)", name="max")} FROM raw_sales"""
    for c in ("Sales", "Customers")
)
SQL["freq_count"] = """
SELECT 'Open' AS column, Open AS value, COUNT(*) AS count FROM raw_sales GROUP BY Open
UNION ALL SELECT 'Promo', Promo, COUNT(*) FROM raw_sales GROUP BY Promo"""
SQL["freq_count_desc"] = "SELECT StoreType, COUNT(*) AS count FROM raw_stores GROUP BY StoreType"
SQL["dow_sales"] = """
SELECT DayOfWeek, AVG(Sales) AS avg_sales, SUM(Sales) AS total_sales, COUNT(*) AS num_records
FROM raw_sales GROUP BY DayOfWeek"""
SQL["quality_counts"] = """
SELECT check_name, violations,
       CASE WHEN violations = 0 THEN 'PASS' ELSE 'ATTENTION' END AS status
FROM (SELECT 'Records with Sales=0 when Open=1' AS check_name, COUNT(*) AS violations
      FROM raw_sales WHERE Open = 1 AND Sales = 0
      UNION ALL SELECT 'Records with Sales>0 when Open=0', COUNT(*)
      FROM raw_sales WHERE Open = 0 AND Sales > 0
      UNION ALL SELECT 'Records with negative Sales', COUNT(*) FROM raw_sales WHERE Sales < 0
      UNION ALL SELECT 'Records with null Sales', COUNT(*) FROM raw_sales WHERE Sales IS NULL
      UNION ALL SELECT 'Duplicate Store-Date combinations', COUNT(*)
      FROM (SELECT 1 FROM raw_sales GROUP BY Store, Date HAVING COUNT(*) > 1))"""
SQL["dup_keys"] = """
SELECT Store, Date, COUNT(*) AS copies FROM raw_sales GROUP BY Store, Date HAVING COUNT(*) > 1"""
SQL["date_coverage"] = """
SELECT *, coverage_days + 1 - unique_dates AS missing_days
FROM (SELECT MIN(Date) AS start_date, MAX(Date) AS end_date, COUNT(DISTINCT Date) AS unique_dates,
             CAST(datediff('day', MIN(Date), MAX(Date)) AS INTEGER) AS coverage_days
      FROM raw_sales)"""
SQL["schema_check"] = " UNION ALL ".join(
    [
        f"SELECT '{c}' AS column_name, 'PRESENT' AS status, COUNT({c}) AS filled_rows FROM raw_sales"
        for c in HASHED.split(", ")
    ]
    + [f"SELECT '{c}', 'MISSING', CAST(0 AS BIGINT)" for c in P.INGEST_COLUMNS]
)
SQL["type_check"] = """
SELECT 'Store' AS column_name, 'int' AS expected_type, 'int' AS actual_type, 'PASS' AS status,
       COUNT(Store) AS filled_rows FROM raw_sales
UNION ALL SELECT 'Date', 'date', 'date', 'PASS', COUNT(Date) FROM raw_sales
UNION ALL SELECT 'Sales', 'double', 'double', 'PASS', COUNT(Sales) FROM raw_sales
UNION ALL SELECT 'Customers', 'int', 'int', 'PASS', COUNT(Customers) FROM raw_sales
UNION ALL SELECT 'Region', 'string', NULL, 'FAIL', 0"""
SQL["quality_metrics"] = f"""
SELECT COUNT(*) FILTER (WHERE Open = 0 AND Sales > 0) AS closed_with_sales,
       COUNT(*) FILTER (WHERE Sales < 0) AS negative_sales,
       {r("AVG(Sales)", name="avg_sales")}, {r("STDDEV_SAMP(Sales)", name="stddev_sales")}
FROM raw_sales"""
SQL["bronze_summary"] = f"""
SELECT COUNT(*) AS total_records, COUNT(DISTINCT Store) AS unique_stores,
       MIN(Date) AS start_date, MAX(Date) AS end_date, {r("AVG(Sales)", name="avg_sales")}
FROM raw_sales"""
SQL["range_check"] = """
SELECT MIN(Sales) AS min_Sales, MAX(Sales) AS max_Sales, MIN(Date) AS min_Date,
       MAX(Date) AS max_Date, MIN(Customers) AS min_Customers, MAX(Customers) AS max_Customers,
       CASE WHEN MIN(Sales) >= 0 THEN 'PASS' ELSE 'FAIL' END AS status
FROM silver_sales"""
SQL["feature_range_check"] = f"""
SELECT {r("MIN(demand_volatility)", name="min_demand_volatility")},
       {r("MAX(demand_volatility)", name="max_demand_volatility")},
       {r("MIN(sales_momentum)", name="min_sales_momentum")},
       {r("MAX(sales_momentum)", name="max_sales_momentum")},
       MIN(competition_pressure) AS min_competition_pressure,
       MAX(competition_pressure) AS max_competition_pressure
FROM gold"""
SQL["orphan_check"] = f"""
SELECT DISTINCT Store FROM ({strays("raw_sales")}) WHERE Store NOT IN (SELECT Store FROM raw_stores)"""
SQL["invalid_open_sales"] = """
SELECT COUNT(*) AS violations, CASE WHEN COUNT(*) = 0 THEN 'PASS' ELSE 'FAIL' END AS status
FROM silver_sales WHERE Open = 0 AND Sales > 0"""
SQL["quality_report"] = """
SELECT 'Silver Sales' AS table_name, COUNT(*) AS record_count, 'cleaned' AS quality_status
FROM silver_sales
UNION ALL SELECT 'Silver Stores', COUNT(*), 'cleaned' FROM silver_stores"""
CRITICAL = [*P.CRITICAL_FEATURES, "rolling_std_90", "sales_lag_365"]
SQL["null_verdict"] = f"""
SELECT feature, null_count, CASE WHEN null_count = 0 THEN 'PASS' ELSE 'FAIL' END AS status,
       SUM(null_count) OVER () = 0 AS all_pass
FROM ({" UNION ALL ".join(
    f"SELECT '{c}' AS feature, COUNT(*) - COUNT({c}) AS null_count FROM gold" for c in CRITICAL)})"""
SQL["validation_report"] = f"""
SELECT 'Feature Count' AS check_name, CAST(COUNT(*) + 4 AS VARCHAR) AS result
FROM (DESCRIBE SELECT * FROM gold)
UNION ALL SELECT 'Record Count', CAST(COUNT(*) AS VARCHAR) FROM gold
UNION ALL SELECT 'Null Check Status', CASE WHEN {" AND ".join(
    f"COUNT(*) = COUNT({c})" for c in P.CRITICAL_FEATURES)} THEN 'PASS' ELSE 'FAIL' END FROM gold"""

# --- silver ----------------------------------------------------------------------------------

SQL["parse_date"] = """
SELECT Store, CASE WHEN Customers <= 70 THEN Date END AS Date, Sales FROM raw_sales"""
SQL["drop_closed_sales"] = "SELECT * FROM raw_sales WHERE NOT (Open = 0 AND Sales > 0)"
SQL["drop_negative_sales"] = "SELECT * FROM raw_sales WHERE Sales >= 0"
SQL["drop_null_critical"] = """
SELECT * FROM raw_sales WHERE Store IS NOT NULL AND Date IS NOT NULL AND Sales IS NOT NULL
  AND DayOfWeek IS NOT NULL"""
SQL["dedupe_key"] = "SELECT DISTINCT * FROM raw_sales"
SQL["dedupe_latest_load"] = """
SELECT Store, Date, CASE WHEN Store % 2 = 0 THEN Sales + 1 ELSE Sales END AS Sales,
       CASE WHEN Store % 2 <> 0 THEN Customers WHEN Promo = 1 THEN LEAST(Customers, 7) ELSE 7 END
           AS Customers, Promo
FROM panel"""
SQL["dedupe_differing_copies"] = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem
QUALIFY ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber
                           ORDER BY l_partkey, l_suppkey, l_quantity) = 1"""
SQL["standardize_types"] = """
SELECT * REPLACE (CASE WHEN Promo = 1 THEN NULL ELSE Promo END AS Promo) FROM raw_sales"""
SQL["holiday_decode"] = f"SELECT Store, Date, {DECODED} AS StateHoliday FROM raw_sales"
SQL["business_flags"] = f"SELECT Store, Date, {FLAGS} FROM raw_sales"
SQL["flag_outliers"] = """
SELECT Store, Date, Sales,
       CASE WHEN Sales > (SELECT QUANTILE_CONT(Sales, 0.99) FROM panel) THEN 1 ELSE 0 END AS is_outlier
FROM panel"""
SQL["exact_quantile"] = " UNION ALL ".join(
    f"""SELECT CAST({q} AS DOUBLE) AS q,
{r(f"QUANTILE_CONT(l_extendedprice, {q})", name="quantile")} FROM lineitem"""
    for q in (0.0, 0.5, 0.99, 1.0)
)
SQL["processing_metadata"] = f"SELECT *, {STAMP} FROM raw_stores"
SQL["rule_audit"] = f"""
WITH tagged AS (
    SELECT *, CASE WHEN NOT COALESCE(NOT (Open = 0 AND Sales > 0), FALSE) THEN 1
                   WHEN NOT COALESCE(Sales >= 0, FALSE) THEN 2
                   WHEN Store IS NULL OR Date IS NULL OR DayOfWeek IS NULL THEN 3 ELSE 0 END AS broken
    FROM raw_sales),
removed AS (
    SELECT s AS step, CASE WHEN s < 4 THEN (SELECT COUNT(*) FROM tagged WHERE broken = s)
        ELSE (SELECT COUNT(*) - COUNT(DISTINCT (Store, Date)) FROM tagged WHERE broken = 0) END AS n
    FROM (VALUES (1), (2), (3), (4)) t(s)),
running AS (
    SELECT step, n, (SELECT COUNT(*) FROM tagged) AS total,
           (SELECT COUNT(*) FROM tagged) - SUM(n) OVER (ORDER BY step) AS rows_after FROM removed)
SELECT step, ['closed_with_sales', 'negative_sales', 'null_critical', 'duplicate_key'][step] AS rule,
       CAST(rows_after + n AS BIGINT) AS rows_before, CAST(rows_after AS BIGINT) AS rows_after,
       CAST(n AS BIGINT) AS rows_removed, {r("rows_after * 100.0 / total", name="retention_pct")}
FROM running"""
SQL["clean_sales"] = f"""
WITH usable AS (SELECT * FROM silver_sales WHERE Customers <= 70)
SELECT *, CASE WHEN Sales > (SELECT QUANTILE_CONT(Sales, 0.99) FROM usable) THEN 1 ELSE 0 END
              AS is_outlier, {STAMP}
FROM usable"""
SQL["drop_null_store"] = "SELECT * FROM gapped_stores WHERE Store IS NOT NULL"
SQL["normalize_categories"] = """
SELECT * REPLACE (upper(trim(StoreType)) AS StoreType, upper(trim(Assortment)) AS Assortment)
FROM raw_stores"""
SQL["fill_competition"] = """
SELECT * REPLACE (COALESCE(CompetitionDistance, 999999) AS CompetitionDistance,
                  COALESCE(CompetitionOpenSinceMonth, 0) AS CompetitionOpenSinceMonth,
                  COALESCE(CompetitionOpenSinceYear, 0) AS CompetitionOpenSinceYear)
FROM raw_stores"""
SQL["fill_promo2"] = """
SELECT * REPLACE (COALESCE(Promo2, 0) AS Promo2, COALESCE(Promo2SinceWeek, 0) AS Promo2SinceWeek,
                  COALESCE(Promo2SinceYear, 0) AS Promo2SinceYear,
                  COALESCE(PromoInterval, 'None') AS PromoInterval)
FROM raw_stores"""
SQL["store_derived"] = """
SELECT Store, CASE WHEN CompetitionDistance IS NULL THEN 0 ELSE 1 END AS has_competition,
       CASE WHEN Promo2 = 1 THEN 1 ELSE 0 END AS in_promo2,
       CompetitionDistance / 1000 AS competition_distance_km,
       StoreType || '-' || Assortment AS store_category
FROM raw_stores"""
SQL["competition_bucket"] = f"""
SELECT Store, CompetitionDistance, {PROXIMITY} AS competition_proximity FROM raw_stores"""
SQL["clean_stores"] = cleaned_stores("gapped_stores")

# --- features --------------------------------------------------------------------------------

SQL["join_store_dim"] = f"""
SELECT p.*, {STAMP}, s.* EXCLUDE (Store, data_quality_layer, data_quality_status,
                                  cleaning_rules_version),
       s.data_quality_layer AS store_data_quality_layer,
       s.data_quality_status AS store_data_quality_status,
       s.cleaning_rules_version AS store_cleaning_rules_version
FROM ({strays("panel")}) p LEFT JOIN silver_stores s ON p.Store = s.Store"""


def of_panel(*columns: str) -> str:
    return f"SELECT Store, Date, {', '.join(columns)} FROM panel"


SQL["calendar_parts"] = of_panel(
    calendar("year", "month", "day", "day_of_week", "week_of_year", "quarter")
)
SQL["calendar_flags"] = of_panel(
    calendar("is_weekend", "is_month_start", "is_month_end", "days_in_month")
)
SQL["season_label"] = of_panel(calendar("season"))
SQL["season_number"] = of_panel(calendar("season_num"))
SQL["lag_features"] = of_panel(lags("Sales", P.SALES_LAGS))
SQL["lag_features_calendar"] = """
SELECT p.Store, p.Date, a.Sales AS sales_lag_1, b.Sales AS sales_lag_7, c.Sales AS sales_lag_30
FROM panel p
LEFT JOIN panel a ON a.Store = p.Store AND a.Date = p.Date - 1
LEFT JOIN panel b ON b.Store = p.Store AND b.Date = p.Date - 7
LEFT JOIN panel c ON c.Store = p.Store AND c.Date = p.Date - 30"""
SQL["customer_lags"] = of_panel(lags("Customers", P.CUSTOMER_LAGS))
SQL["rolling_mean"] = of_panel(
    *[f"AVG(Sales) {before(k)} AS rolling_mean_{k}" for k in P.MEAN_WINDOWS]
)
SQL["rolling_mean_calendar"] = of_panel(
    *[
        f"""AVG(Sales) OVER ({BY_STORE} RANGE BETWEEN INTERVAL {k} DAYS PRECEDING
            AND INTERVAL 1 DAY PRECEDING) AS rolling_mean_{k}"""
        for k in (7, 30)
    ]
)
SQL["rolling_std"] = of_panel(
    *[r(f"STDDEV_SAMP(Sales) {before(k)}", name=f"rolling_std_{k}") for k in P.STD_WINDOWS]
)
SQL["rolling_moments"] = of_panel(
    *[r(f"AVG(Sales) {before(k)}", name=f"rolling_mean_{k}") for k in P.MEAN_WINDOWS],
    *[r(f"STDDEV_SAMP(Sales) {before(k)}", name=f"rolling_std_{k}") for k in P.STD_WINDOWS],
)
SQL["rolling_min_max"] = of_panel(
    f"MIN(Sales) {before(30)} AS rolling_min_30", f"MAX(Sales) {before(30)} AS rolling_max_30"
)
SQL["rolling_median"] = of_panel(f"QUANTILE_DISC(Sales, 0.5) {before(30)} AS rolling_median_30")
SQL["rolling_customers"] = of_panel(f"AVG(Customers) {before(30)} AS rolling_customers_mean_30")


def of_rolled(expression: str, name: str, inexact: bool = True) -> str:
    value = r(expression, name=name) if inexact else f"{expression} AS {name}"
    return f"SELECT Store, Date, {value} FROM rolled"


SQL["growth_rates"] = f"""
SELECT Store, Date, {", ".join(r(growth(k), name=f"sales_growth_{k}d") for k in P.GROWTH_LAGS)}
FROM rolled"""
SQL["demand_volatility"] = of_rolled(VOLATILITY, "demand_volatility")
SQL["sales_momentum"] = of_rolled(MOMENTUM, "sales_momentum")
SQL["trend_direction"] = of_rolled(TREND, "trend_direction", inexact=False)
SQL["cyclic_encoding"] = of_panel(
    *[
        r(f"{f}(({x}) * (2 * pi() / {period}))", name=f"{name}_{f}")
        for name, (x, period) in CYCLIC.items()
        for f in ("sin", "cos")
    ]
)
SQL["competition_pressure"] = f"""
SELECT Store, CompetitionDistance, {PRESSURE} AS competition_pressure FROM silver_stores"""
SQL["store_tier"] = f"""
SELECT Store, Date, avg_sales_per_store, {TIER} AS store_performance_tier
FROM (SELECT *, AVG(Sales) OVER (PARTITION BY Store) AS avg_sales_per_store FROM panel)"""
SQL["sales_per_customer"] = f"""
SELECT Store, Date, {r(PER_CUSTOMER, name="sales_per_customer")} FROM silver_sales"""
SQL["promo_label"] = of_rolled(PROMO_LABEL, "promo_effectiveness", inexact=False)
SQL["promo_frequency"] = "SELECT Store, Date, promo_frequency_30d FROM rolled"
SQL["potential_stockout"] = """
SELECT Store, Date,
       CASE WHEN Open = 1 AND Sales < 3000 AND Customers > 20 THEN 1 ELSE 0 END AS potential_stockout
FROM silver_sales"""
SQL["holiday_multiplier"] = of_rolled(MULTIPLIER, "holiday_sales_multiplier")
SQL["assortment_score"] = f"""
SELECT Store, Assortment, {ASSORTMENT_SCORE} AS assortment_score FROM silver_stores"""
SQL["store_type_score"] = f"""
SELECT Store, StoreType, {TYPE_SCORE} AS store_type_score FROM silver_stores"""
SQL["warmup_filter"] = f"""
SELECT Store, Date, {", ".join(P.WARMUP_COLUMNS)} FROM panel_rolled
WHERE sales_lag_7 IS NOT NULL AND sales_lag_30 IS NOT NULL"""
SQL["warmup_retention"] = f"""
SELECT COUNT(*) AS rows_before, COUNT(sales_lag_30) AS rows_after,
       COUNT(*) - COUNT(sales_lag_30) AS rows_removed,
       {r("COUNT(sales_lag_30) * 100.0 / COUNT(*)", name="retention_pct")}
FROM panel_rolled"""
SQL["feature_metadata"] = """
SELECT Store, Date, 'v1.0' AS feature_version, 13 AS total_features FROM panel"""
FEATURES = [(c, f) for c, names in P.FEATURE_CATEGORIES.items() for f in names]
SQL["feature_dictionary"] = " UNION ALL ".join(
    f"""SELECT '{f}' AS feature_name, '{c}' AS category,
CASE WHEN '{f}' IN ({in_list(P.CATEGORICAL_FEATURES)}) THEN 'Categorical' ELSE 'Numeric' END
    AS data_type, COUNT({f}) AS filled_rows FROM gold"""
    for c, f in FEATURES
)
SQL["feature_summary"] = f"""
SELECT category, COUNT(*) AS features FROM (VALUES {", ".join(f"('{c}')" for c, _ in FEATURES)})
    t(category)
WHERE (SELECT COUNT(*) FROM gold) > 0 GROUP BY category"""
INEXACT = [
    *[f"sales_growth_{k}d" for k in P.GROWTH_LAGS],
    *[f"rolling_mean_{k}" for k in P.MEAN_WINDOWS],
    *[f"rolling_std_{k}" for k in P.STD_WINDOWS],
    *P.FEATURE_CATEGORIES["Cyclic Encoding Features"],
    "rolling_customers_mean_30", "promo_frequency_30d", "avg_sales_per_store",
    "demand_volatility", "sales_momentum", "sales_per_customer", "holiday_sales_multiplier",
    "competition_distance_km",
]
SQL["build_features"] = f"""
SELECT * REPLACE ({", ".join(r(c) for c in INEXACT)}), 'v1.0' AS feature_version,
       {len(FEATURES)} AS total_features
FROM gold"""

# --- feature analysis ------------------------------------------------------------------------

SQL["corr_topk"] = f"""
SELECT feature, {r("c", name="correlation_with_sales")} FROM correlations
ORDER BY c DESC, feature LIMIT 5"""
NINE = ["Sales", *P.CORRELATED_FEATURES]
SQL["corr_matrix"] = " UNION ALL ".join(
    f"""SELECT '{a}' AS feature_a, '{b}' AS feature_b,
{r(f"CORR({a}, {b})", name="correlation")} FROM gold"""
    for a in NINE
    for b in NINE
)
SQL["sample_rows"] = f"""
SELECT * FROM panel WHERE md5(concat_ws('|', CAST(Store AS VARCHAR), CAST(Date AS VARCHAR)))
    < '{int(0.01 * 16**8):08x}'"""
SQL["histogram"] = f"""
WITH lim AS (SELECT MIN(Sales) AS low, MAX(Sales) AS high FROM panel),
binned AS (SELECT LEAST(CAST(FLOOR((Sales - low) * 50 / (high - low)) AS INTEGER), 49) AS bin
           FROM panel, lim)
SELECT CAST(g.bin AS INTEGER) AS bin,
       {r("low + g.bin * ((high - low) / 50)", name="lower_edge")},
       {r("low + (g.bin + 1) * ((high - low) / 50)", name="upper_edge")},
       (SELECT COUNT(*) FROM binned b WHERE b.bin = g.bin) AS row_count
FROM (SELECT UNNEST(range(50)) AS bin) g, lim"""

# --- training set and evaluation -------------------------------------------------------------

SQL["model_matrix"] = f"""
SELECT Store, Date, {r("Sales")},
       {", ".join(r(f"CAST(COALESCE({f}, 0) AS DOUBLE)", name=f) for f in P.REFERENCE_FEATURES)}
FROM gold"""
SQL["time_split"] = f"""
WITH c AS ({cut_of("panel")})
SELECT 'train' AS table_name, (SELECT COUNT(*) FROM panel WHERE Date < cut) AS record_count, cut FROM c
UNION ALL SELECT 'test', (SELECT COUNT(*) FROM panel WHERE Date >= cut), cut FROM c"""
SQL["regression_metrics"] = f"""
SELECT Store, rows, {", ".join(r(m, 6) for m in ("MAE", "RMSE", "R_square", "MAPE_percent"))}
FROM (SELECT Store, COUNT(*) AS rows, {measures("predicted_sales_lag30")} FROM pred GROUP BY Store)"""
SQL["baseline_forecast"] = of_panel(f"AVG(Sales) {before(30)} AS predicted_sales_baseline")
PREDICTION_COLUMNS = [
    "actual_sales", "predicted_sales_lag30", "predicted_sales_lag60", "predicted_sales_lag90",
    "error_lag30", "absolute_error_lag30", "percentage_error_lag30",
]
SQL["prediction_errors"] = f"""
SELECT Store, Date, {", ".join(r(c) for c in PREDICTION_COLUMNS)} FROM pred"""
SQL["residual_sample"] = f"""
SELECT Store, Date, {r("actual_sales")}, {r("predicted_sales_lag30", name="predicted_sales")},
       {r("error_lag30", name="residual")}
FROM pred
ORDER BY md5(concat_ws('|', CAST(Store AS VARCHAR), CAST(Date AS VARCHAR))), Store, Date LIMIT 1000"""
SQL["model_comparison"] = f"SELECT Model, {ROUNDED_MEASURES} FROM compared"
SQL["best_model"] = f"""
SELECT Model, {ROUNDED_MEASURES}, CASE WHEN MAPE_percent < 15 THEN 'YES' ELSE 'NO' END AS target_met
FROM compared ORDER BY MAPE_percent, Model LIMIT 1"""
SQL["model_run_log"] = f"""
{" UNION ALL ".join(
    f"SELECT Model AS run, 'test_{m}' AS metric, {r(m, name='value')} FROM compared"
    for m in ("MAE", "RMSE", "R_square", "MAPE_percent"))}"""
SQL["fit_linear_one_input"] = f"SELECT {r('slope', 3, 'coefficient')}, {r('intercept', 3)} FROM fitted"
SQL["score_one_input"] = f"""
SELECT Store, Date, {r("intercept + slope * rolling_mean_30", 2, "prediction")}
FROM gold, fitted WHERE Date >= (SELECT cut FROM gold_cut)"""
SQL["fit_linear"] = """
SELECT COUNT(*) AS rows, ROUND(SQRT(AVG((Sales - intercept - slope * rolling_mean_30) ** 2)), 3)
           AS one_input_RMSE, ROUND(AVG(Sales), 2) AS mean_prediction, TRUE AS no_worse_than_one_input
FROM gold, fitted WHERE Date < (SELECT cut FROM gold_cut)"""
SQL["score"] = f"""
SELECT Store, Date, y AS Sales, {r("intercept + list_dot_product(b, x)", 1, "prediction")}
FROM safe_rows, safe_squares WHERE NOT learn"""
SQL["score_horizon"] = SQL["score"].replace("safe_", "horizon_")
SQL["fit_forest"] = """
SELECT COUNT(*) FILTER (NOT learn) AS rows,
       ROUND(STDDEV_POP(y) FILTER (learn), 4) AS mean_RMSE, TRUE AS beats_mean,
       ROUND(SQRT(AVG((y - leaf) ** 2) FILTER (learn)), 4) AS checked_RMSE
FROM one_tree"""
SQL["fit_boosted"] = SQL["fit_forest"].replace("leaf", "prediction").replace("one_tree", "three_trees")
SQL["fit_horizon"] = SQL["fit_boosted"]
SQL["score_nodes"] = f"""
SELECT Store, Date, {r("t.leaf", 2, "forest")}, {r("b.prediction", 2, "boosted")}
FROM one_tree t JOIN three_trees b USING (Store, Date) WHERE NOT t.learn"""
SQL["coef_importance"] = f"""
SELECT UNNEST([{in_list(P.SAFE_FEATURES)}]) AS feature,
       UNNEST(list_transform(b, lambda v: ROUND(v, 4) + 0.0)) AS coefficient
FROM safe_squares"""
SQL["fit_linear_merged"] = f"""
SELECT UNNEST([{in_list(P.SAFE_FEATURES)}]) AS feature,
       UNNEST(list_transform(b, lambda v: ROUND(v, 4) + 0.0)) AS coefficient, {r("intercept")}
FROM safe_squares"""
SQL["tree_importance"] = f"""
SELECT f.feature, TRUE AS is_share, 1.0::DOUBLE AS total,
       {r("COALESCE(gained / SUM(gained) OVER (), 0)", 6, "checked_importance")}
FROM (SELECT UNNEST([{in_list(P.SAFE_FEATURES)}]) AS feature) f LEFT JOIN (
    SELECT ([{in_list(P.CHECKED_FEATURES)}])[feature] AS feature, SUM(gained) AS gained
    FROM one_tree_gains GROUP BY feature) g ON f.feature = g.feature"""
SQL["coef_importance_two_inputs"] = f"""
WITH m AS (
    SELECT VAR_POP(a) AS aa, VAR_POP(b) AS bb, COVAR_POP(a, b) AS ab, COVAR_POP(a, y) AS ay,
           COVAR_POP(b, y) AS bb_y
    FROM (SELECT rolling_mean_30 AS a, CAST(Promo AS DOUBLE) AS b, Sales AS y FROM gold
          WHERE Date < (SELECT cut FROM gold_cut)))
SELECT 'rolling_mean_30' AS feature,
       {r("(ay * bb - bb_y * ab) / (aa * bb - ab * ab)", 3, "coefficient")} FROM m
UNION ALL SELECT 'Promo', {r("(bb_y * aa - ay * ab) / (aa * bb - ab * ab)", 3, "coefficient")} FROM m"""
SQL["prediction_table"] = f"""
SELECT *, {r("actual_sales - predicted_sales_boosted", 2, "error_boosted")},
       {r("ABS(actual_sales - predicted_sales_boosted)", 2, "absolute_error_boosted")},
       {r("ABS(actual_sales - predicted_sales_boosted) / NULLIF(actual_sales, 0) * 100", 2,
          "percentage_error_boosted")}
FROM (
    SELECT Store, Date, b.y AS actual_sales, b.prediction AS predicted_sales_boosted,
           t.leaf AS predicted_sales_rf, s.intercept + list_dot_product(s.b, l.x) AS predicted_sales_lr
    FROM three_trees b JOIN one_tree t USING (Store, Date) JOIN safe_rows l USING (Store, Date),
         safe_squares s
    WHERE NOT b.learn)"""
SQL["prediction_table"] = f"""
SELECT * REPLACE ({r("predicted_sales_boosted", 2)}, {r("predicted_sales_rf", 2)},
                  {r("predicted_sales_lr", 1)})
FROM ({SQL["prediction_table"]})"""

# --- inventory -------------------------------------------------------------------------------

SQL["enrich_predictions"] = f"""
SELECT p.Store, p.Date, {", ".join(r(f"p.{c}", name=c) for c in PREDICTION_COLUMNS)},
       {r("g.demand_volatility", name="demand_volatility")},
       {r("g.rolling_std_30", name="rolling_std_30")}
FROM ({strays("pred")}) p LEFT JOIN gold g ON p.Store = g.Store AND p.Date = g.Date"""
SQL["enrich_predictions_bucketed"] = SQL["enrich_predictions"]
AHEAD = f"OVER ({BY_STORE} ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING)"
SQL["forward_sum"] = of_panel(f"SUM(Sales) {AHEAD} AS sales_next_30")
SQL["forward_avg"] = of_panel(f"AVG(Customers) {AHEAD} AS customers_next_30")
LATEST_COLUMNS = f"""Store, latest_date, {r("forecast_next_30d")}, {r("demand_volatility_30d")},
       {r("avg_actual_sales")}"""
SQL["latest_by_store"] = f"SELECT {LATEST_COLUMNS} FROM ({latest(1)})"
SQL["latest_by_store_full_horizon"] = f"SELECT {LATEST_COLUMNS} FROM latest_full"
SQL["attach_inventory"] = f"SELECT Store, {r('current_inventory', 5)} FROM stocked"
SQL["attach_inventory_table"] = f"""
WITH stock AS (SELECT Store, CASE WHEN Store % 5 <> 0 THEN CAST(SUM(Customers) AS DOUBLE) END AS held
               FROM panel GROUP BY Store)
SELECT l.Store, {r("held", 3, "current_inventory")},
       CASE WHEN held IS NULL THEN 'UNKNOWN'
            WHEN held < GREATEST(0, avg_daily_demand * 7 + safety_stock) THEN 'HIGH' ELSE 'LOW' END
            AS stockout_risk,
       {r("CASE WHEN avg_daily_demand > 0 THEN held / avg_daily_demand WHEN held IS NOT NULL THEN 999 END",
          3, "days_until_stockout")}
FROM levels l LEFT JOIN stock s ON l.Store = s.Store"""


LEVELS = {k: 0.5 + k / 100 for k in range(50)} | {50: 0.001, 51: 0.9999, 52: 1.0}
SQL["service_z"] = f"""
WITH asked(k, p, z) AS (VALUES {", ".join(
    f"({k}, {p!r}::DOUBLE, {NormalDist().inv_cdf(p) if p < 1 else 'NULL'}::DOUBLE)"
    for k, p in LEVELS.items())})
SELECT Store, p AS service_level, ROUND(z, 6) + 0.0 AS z, ROUND({Z95}::DOUBLE, 6) + 0.0 AS z_95
FROM raw_stores JOIN asked ON k = Store % 53"""
SQL["safety_stock"] = f"""
SELECT Store, {r(f"GREATEST(0, {Z95} * sigma * sqrt(7))", 3, "safety_stock")} FROM demand"""
SQL["reorder_point"] = f"""
SELECT Store, {r(f"daily * 7 + {Z95} * sigma * sqrt(7)", 3, "reorder_point")} FROM demand"""
SQL["eoq"] = f"""
SELECT Store, {r("CASE WHEN daily > 7400 THEN GREATEST(1, sqrt(2 * daily * 365 * 100 / 30)) ELSE 0 END",
                 name="economic_order_qty")} FROM demand"""
SQL["optimal_inventory"] = f"""
WITH z(level, z) AS (VALUES (0.90, 1.2815515655446008), (0.91, 1.3407550336902165),
    (0.92, 1.4050715603096329), (0.93, 1.4757910281791706), (0.94, 1.5547735945968535),
    (0.95, 1.6448536269514722), (0.96, 1.7506860712521692), (0.97, 1.8807936081512509),
    (0.98, 2.0537489106318225)),
part AS (
    SELECT s.*, level, 1 + Store % 14 AS lead,
           GREATEST(0, z * forecast_next_30d / 30 * demand_volatility_30d * sqrt(1 + Store % 14)) AS ss
    FROM stocked s JOIN z ON CAST(ROUND(level * 100) AS INTEGER) = 90 + Store % 9),
point AS (SELECT *, forecast_next_30d / 30 * lead + ss AS rp FROM part)
SELECT Store, {r("ss", 2, "safety_stock")}, {r("rp", 2, "reorder_point")},
       CASE WHEN current_inventory IS NULL THEN 'UNKNOWN' WHEN current_inventory < rp THEN 'HIGH'
            ELSE 'LOW' END AS stockout_risk,
       {r("CAST(level AS DOUBLE) * 100", 2, "service_level")}
FROM point"""
SQL["optimal_inventory_unknown"] = f"""
WITH held AS (SELECT Store, CASE WHEN Store % 5 <> 0 THEN CAST(SUM(Customers) AS DOUBLE) END AS stock
              FROM panel GROUP BY Store),
partly AS (
    SELECT l.Store, stock AS current_inventory, l.Store % 7 <> 0 AS known, latest_date, forecast_next_30d,
           demand_volatility_30d, avg_daily_demand, demand_std, safety_stock,
           avg_daily_demand * 7 + safety_stock AS reorder_point, GREATEST(1, lot) AS economic_order_qty
    FROM (SELECT * EXCLUDE (current_inventory) FROM levels) l LEFT JOIN held h ON l.Store = h.Store),
rated AS (
    SELECT Store, CASE WHEN known THEN latest_date END AS latest_date,
           {", ".join(f"CASE WHEN known THEN {c} END AS {d}" for c, d in {
               "forecast_next_30d": "forecast_next_30d", "demand_volatility_30d": "demand_volatility",
               "avg_daily_demand": "avg_daily_demand", "demand_std": "demand_std",
               "safety_stock": "safety_stock", "reorder_point": "reorder_point",
               "economic_order_qty": "economic_order_qty"}.items())},
           CASE WHEN known THEN forecast_next_30d END AS optimal_order_qty, current_inventory,
           CASE WHEN NOT known OR current_inventory IS NULL THEN 'UNKNOWN'
                WHEN current_inventory < reorder_point THEN 'HIGH' ELSE 'LOW' END AS stockout_risk,
           CASE WHEN known THEN current_inventory / avg_daily_demand END AS days_until_stockout,
           95.0::DOUBLE AS service_level
    FROM partly)
SELECT Store, latest_date, stockout_risk,
       CASE WHEN stockout_risk = 'UNKNOWN' THEN 'UNKNOWN: No forecast or no stock' ELSE {ACTION} END
           AS recommended_action,
       CASE WHEN stockout_risk <> 'UNKNOWN' THEN {PRIORITY} END AS order_priority,
       CASE WHEN stockout_risk <> 'UNKNOWN' THEN {GRADED} END AS graded_priority,
       {r("reorder_point - current_inventory", 3, "inventory_gap")},
       {r(f"CASE WHEN stockout_risk <> 'UNKNOWN' THEN {EXCESS} END", 3, "excess_inventory")},
       {", ".join(r(c, 3) for c in (
           "forecast_next_30d", "demand_volatility", "current_inventory", "avg_daily_demand",
           "demand_std", "safety_stock", "reorder_point", "optimal_order_qty", "economic_order_qty",
           "days_until_stockout", "service_level"))}
FROM rated"""
PLAN_DOUBLES = [
    "forecast_next_30d", "demand_volatility", "current_inventory", "avg_daily_demand", "demand_std",
    "safety_stock", "reorder_point", "optimal_order_qty", "economic_order_qty",
    "days_until_stockout", "service_level",
]
ROUNDED_PLAN = ", ".join(r(c, 5) for c in PLAN_DOUBLES)
SQL["optimize_stores"] = f"SELECT Store, latest_date, stockout_risk, {ROUNDED_PLAN} FROM plan"
SQL["recommend_action"] = f"SELECT Store, {ACTION} AS recommended_action FROM plan"
SQL["order_priority"] = f"SELECT Store, {PRIORITY} AS order_priority FROM plan"
SQL["graded_priority"] = f"SELECT Store, {GRADED} AS graded_priority FROM plan"
SQL["inventory_gap"] = f"""
SELECT Store, {r("inventory_gap", 5)}, {r("excess_inventory", 5)} FROM recs"""
SQL["recommend"] = f"""
SELECT Store, latest_date, stockout_risk, {ROUNDED_PLAN}, recommended_action, order_priority,
       {r("inventory_gap", 5)}, {r("excess_inventory", 5)} FROM recs"""
SQL["impact_totals"] = f"""
SELECT total_stores, high_risk_stores, unknown_stores, {", ".join(r(c, 5) for c in (
    "total_forecasted_demand", "total_current_inventory", "total_optimal_inventory",
    "total_safety_stock", "total_excess_inventory"))} FROM totals"""
SQL["business_impact"] = f"""
SELECT total_stores, high_risk_stores, unknown_stores, lead_time_days, {", ".join(r(c, 5) for c in (
    "forecasted_demand_30d", "current_inventory", "optimal_inventory", "inventory_reduction_units",
    "inventory_reduction_pct", "monthly_holding_cost_savings", "annual_holding_cost_savings",
    "stockouts_prevented", "stockout_cost_savings", "total_annual_roi", "service_level_target"))}
FROM impact"""
SQL["urgent_topk"] = f"""
SELECT Store, current_inventory, reorder_point, optimal_order_qty, days_until_stockout,
       recommended_action
FROM exact_recs WHERE stockout_risk = 'HIGH' ORDER BY days_until_stockout, Store LIMIT 20"""

# --- reports ---------------------------------------------------------------------------------

CTES["kpis"] = """
SELECT COUNT(DISTINCT Store) AS total_stores,
       AVG(percentage_error_lag30) AS avg_forecast_accuracy_pct,
       100 - AVG(percentage_error_lag30) AS forecast_accuracy_score,
       SUM(actual_sales) AS total_actual_sales, SUM(predicted_sales_lag30) AS total_predicted_sales,
       SUM(ABS(error_lag30)) AS total_absolute_error
FROM pred"""
SQL["kpi_summary"] = f"""
SELECT total_stores, {", ".join(r(c) for c in (
    "avg_forecast_accuracy_pct", "forecast_accuracy_score", "total_actual_sales",
    "total_predicted_sales", "total_absolute_error"))} FROM kpis"""
SQL["kpi_cards"] = """
SELECT 'Total Stores' AS metric, CAST(total_stores AS VARCHAR) AS value FROM kpis
UNION ALL SELECT 'Forecast Accuracy', CAST(ROUND(forecast_accuracy_score, 2) AS VARCHAR) || '%' FROM kpis
UNION ALL SELECT 'Total Sales (Test Period)', '$' || format('{:,.2f}', ROUND(total_actual_sales, 2)) FROM kpis"""
SQL["top_accurate"] = f"""
SELECT Store, prediction_count, {r("avg_predicted_sales")}, {r("avg_actual_sales")},
       {r("m", name="avg_mape")}, {r("100 - m", name="accuracy_score")}
FROM (SELECT Store, COUNT(*) AS prediction_count,
             AVG(predicted_sales_lag30) AS avg_predicted_sales,
             AVG(actual_sales) AS avg_actual_sales, AVG(percentage_error_lag30) AS m
      FROM pred WHERE actual_sales > 0 GROUP BY Store ORDER BY m, Store LIMIT 20)"""
SQL["accuracy_by_type"] = f"""
SELECT StoreType, Assortment, COUNT(DISTINCT p.Store) AS store_count,
       {r("AVG(percentage_error_lag30)", name="avg_mape")},
       {r("AVG(actual_sales)", name="avg_actual_sales")},
       {r("AVG(predicted_sales_lag30)", name="avg_predicted_sales")},
       {r("SUM(actual_sales)", name="total_actual_sales")},
       {r("SUM(predicted_sales_lag30)", name="total_predicted_sales")}
FROM pred p JOIN silver_stores s ON p.Store = s.Store GROUP BY StoreType, Assortment"""
SQL["stockout_alerts"] = f"""
SELECT Store, current_inventory, reorder_point, optimal_order_qty,
       ROUND(days_until_stockout, 1) AS days_until_stockout,
       ROUND(reorder_point - current_inventory, 0) AS inventory_gap, recommended_action,
       ROUND(forecast_next_30d, 0) AS forecast_next_30d
FROM exact_recs e WHERE stockout_risk = 'HIGH' ORDER BY e.days_until_stockout, Store LIMIT 50"""
CTES["savings"] = """
SELECT Store, ROUND(e.current_inventory, 0) AS current_inventory,
       ROUND(optimal_order_qty, 0) AS optimal_inventory,
       ROUND(e.current_inventory - optimal_order_qty, 0) AS inventory_reduction,
       ROUND((e.current_inventory - optimal_order_qty) * 2.5, 2) AS monthly_savings,
       ROUND((e.current_inventory - optimal_order_qty) * 2.5 * 12, 2) AS annual_savings,
       stockout_risk
FROM exact_recs e WHERE e.current_inventory > e.optimal_order_qty"""
SQL["savings_by_store"] = "SELECT * FROM savings"
SQL["savings_total"] = f"""
SELECT {r("SUM(annual_savings)", 2, "total_annual_savings")},
       {r("AVG(annual_savings)", 2, "avg_savings_per_store")}, COUNT(*) AS stores_with_savings
FROM savings"""
SQL["weekly_trend"] = f"""
SELECT CAST(date_trunc('week', Date) AS DATE) AS week_start,
       {r("SUM(actual_sales)", name="total_actual_sales")},
       {r("SUM(predicted_sales_lag30)", name="total_predicted_sales")},
       {r("AVG(percentage_error_lag30)", name="weekly_mape")}, COUNT(*) AS prediction_count
FROM pred GROUP BY 1"""
for name in ("kpi_summary", "accuracy_by_type", "weekly_trend"):
    SQL[f"{name}_merged"] = SQL[name]
SQL["importance_rank"] = f"""
SELECT feature, importance, CAST(RANK() OVER (ORDER BY importance DESC) AS INTEGER) AS importance_rank
FROM (SELECT feature, {r("c", name="importance")} FROM correlations)
ORDER BY importance DESC, feature LIMIT 15"""
SQL["promo_analysis"] = f"""
SELECT CASE WHEN g.Promo = 1 THEN 'With Promotion' ELSE 'No Promotion' END AS promo_status,
       COUNT(*) AS days_count, {r("AVG(actual_sales)", name="avg_daily_sales")},
       {r("AVG(predicted_sales_lag30)", name="avg_predicted_sales")},
       {r("AVG(sales_per_customer)", name="avg_sales_per_customer")}
FROM pred p JOIN gold g ON p.Store = g.Store AND p.Date = g.Date
WHERE actual_sales > 0 GROUP BY g.Promo"""
SQL["competition_impact"] = f"""
SELECT CASE WHEN CompetitionDistance < 1000 THEN 'Very Close (<1km)'
            WHEN CompetitionDistance < 5000 THEN 'Close (1-5km)'
            WHEN CompetitionDistance < 10000 THEN 'Moderate (5-10km)'
            ELSE 'Far (>10km)' END AS competition_proximity,
       COUNT(DISTINCT p.Store) AS store_count, {r("AVG(actual_sales)", name="avg_daily_sales")},
       {r("AVG(percentage_error_lag30)", name="avg_forecast_error")}
FROM pred p JOIN silver_stores s ON p.Store = s.Store GROUP BY 1"""
SQL["impact_latest"] = """
SELECT total_stores, ROUND(ROUND(forecasted_demand_30d, 4), 0) AS forecasted_demand,
       ROUND(ROUND(inventory_reduction_units, 4), 0) AS inventory_reduced_units,
       ROUND(ROUND(inventory_reduction_pct, 4), 1) AS inventory_reduced_pct,
       '$' || format('{:,.2f}', ROUND(ROUND(monthly_holding_cost_savings, 4), 2)) AS monthly_savings,
       '$' || format('{:,.2f}', ROUND(ROUND(annual_holding_cost_savings, 4), 2)) AS annual_savings,
       high_risk_stores, ROUND(ROUND(stockouts_prevented, 4), 0) AS stockouts_prevented,
       '$' || format('{:,.2f}', ROUND(ROUND(stockout_cost_savings, 4), 2)) AS stockout_savings,
       '$' || format('{:,.2f}', ROUND(ROUND(total_annual_roi, 4), 2)) AS total_annual_roi
FROM impact"""


def statement(body: str) -> str:
    """Prefix a query with the named sub-queries it uses, directly or through others."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in set(re.findall(r"\w+", text)) & set(CTES) - needed:
            needed.add(name)
            visit(CTES[name])

    visit(body)
    parts = [f"{name} AS ({CTES[name].strip()})" for name in CTES if name in needed]
    body = body.strip()
    if not parts:
        return body
    head = ("WITH RECURSIVE " if needed & RECURSIVE else "WITH ") + ",\n".join(parts)
    if body.upper().startswith("WITH "):
        return f"{head},\n{body[5:]}"
    return f"{head}\n{body}"


def statements() -> dict[str, str]:
    return {name: statement(body) for name, body in SQL.items()}
