"""Forecast roll-up, stock levels, recommended actions and business impact."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.columns import normal_quantile
from larder.operators.features import by_store
from larder.params import ACTIONS, FORECAST_ROWS, PRIMARY_MODEL, InventoryPolicy

DEFAULT = InventoryPolicy()


def enrich(predictions: DataFrame, features: DataFrame) -> DataFrame:
    """Predictions with the volatility of the same store and day, where there is one.

    Not needed where the predictions were made with the volatility carried along.
    """
    volatility = features.select("Store", "Date", "demand_volatility", "rolling_std_30")
    return predictions.join(volatility, ["Store", "Date"], "left")


def forward_sum(df: DataFrame, column: str, name: str, rows: int = FORECAST_ROWS) -> DataFrame:
    """Sum over the current and the following rows of the store."""
    return df.withColumn(name, F.sum(column).over(by_store().rowsBetween(0, rows - 1)))


def forward_avg(df: DataFrame, column: str, name: str, rows: int = FORECAST_ROWS) -> DataFrame:
    return df.withColumn(name, F.avg(column).over(by_store().rowsBetween(0, rows - 1)))


def roll_forward(
    df: DataFrame, model: str = PRIMARY_MODEL, rows: int = FORECAST_ROWS
) -> DataFrame:
    """Forecast sum, mean volatility and length of each row's forward frame."""
    summed = forward_sum(df, f"predicted_sales_{model}", "forecast_30d", rows)
    averaged = forward_avg(summed, "demand_volatility", "avg_volatility_30d", rows)
    frame = by_store().rowsBetween(0, rows - 1)
    return averaged.withColumn("horizon_rows", F.count("*").over(frame))


def latest_by(
    df: DataFrame,
    key: str,
    order: str,
    latest: Mapping[str, str],
    means: Mapping[str, str],
    min_horizon_rows: int = 1,
) -> DataFrame:
    """Per key: the latest date, columns as of that date, and means over all rows.

    ``min_horizon_rows`` passes over the last dates, whose forward frame is cut short: 1 takes
    the last date there is, the frame's length takes the last one with a full frame. A key
    without such a date keeps its row, with NULLs.
    """
    at = F.when(F.col("horizon_rows") >= min_horizon_rows, F.col(order))
    return df.groupBy(key).agg(
        F.max(at).alias("latest_date"),
        *[F.max_by(source, at).alias(name) for name, source in latest.items()],
        *[F.avg(source).alias(name) for name, source in means.items()],
    )


def latest_forecast(df: DataFrame, min_horizon_rows: int = FORECAST_ROWS) -> DataFrame:
    """Forecast and volatility per store at its latest date with a long enough frame."""
    return latest_by(
        df,
        "Store",
        "Date",
        latest={
            "forecast_next_30d": "forecast_30d",
            "demand_volatility_30d": "avg_volatility_30d",
        },
        means={"avg_actual_sales": "actual_sales"},
        min_horizon_rows=min_horizon_rows,
    )


def attach_inventory(df: DataFrame, inventory: DataFrame | None = None) -> DataFrame:
    """Current stock from a table (Store, current_inventory).

    Without a table a repeatable stand-in of 0 to 60 days of supply is computed from the store
    number. Stores missing from a given table keep a NULL stock.
    """
    if inventory is not None:
        return df.join(inventory.select("Store", "current_inventory"), "Store", "left")
    days = (F.col("Store") * 37 + 11) % 61
    return df.withColumn("current_inventory", days * F.col("forecast_next_30d") / 30)


def z_score(service_level: float | Column) -> Column:
    return normal_quantile(service_level)


def _at_least(floor: float, value: Column) -> Column:
    """``max(floor, value)``, where NaN counts as the floor and NULL stays unknown."""
    return F.when(value.isNotNull(), F.greatest(F.lit(floor), F.nanvl(value, F.lit(floor))))


def safety_stock(demand_std: Column, z: Column, lead_time_days: float | Column) -> Column:
    return _at_least(0.0, z * demand_std * F.sqrt(_column(lead_time_days)))


def reorder_point(daily_demand: Column, safety: Column, lead_time_days: float | Column) -> Column:
    return _at_least(0.0, daily_demand * _column(lead_time_days) + safety)


def economic_order_quantity(annual_demand: Column, order_cost: float, holding_cost: float) -> Column:
    """Square-root lot size of at least 1; a month's demand where cost or demand is not positive."""
    if holding_cost <= 0:
        return annual_demand / 12
    lot = F.sqrt(2 * F.when(annual_demand > 0, annual_demand) * order_cost / holding_cost)
    return F.when(annual_demand <= 0, annual_demand / 12).otherwise(_at_least(1.0, lot))


def _column(value: float | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def optimal_inventory(
    df: DataFrame,
    policy: InventoryPolicy = DEFAULT,
    service_level: Column | None = None,
    lead_time_days: Column | None = None,
) -> DataFrame:
    """Stock levels, lot sizes and stock-out risk per row, all as column expressions.

    Level and lead time come from the policy or, row by row, from columns. Without a forecast the
    levels are NULL, and without a forecast or a stock the risk is UNKNOWN.
    """
    level = F.lit(policy.service_level) if service_level is None else service_level
    z = z_score(policy.service_level if service_level is None else service_level)
    lead = _column(policy.lead_time_days if lead_time_days is None else lead_time_days)
    forecast, stock = F.col("forecast_next_30d"), F.col("current_inventory")
    daily = F.col("avg_daily_demand")
    annual_holding = policy.holding_cost_per_month * 12
    return (
        df.withColumn("avg_daily_demand", forecast / 30)
        .withColumn("demand_std", daily * F.col("demand_volatility_30d"))
        .withColumn("safety_stock", safety_stock(F.col("demand_std"), z, lead))
        .withColumns(
            {
                "reorder_point": reorder_point(daily, F.col("safety_stock"), lead),
                "optimal_order_qty": forecast,
                "economic_order_qty": economic_order_quantity(
                    forecast * 12, policy.order_cost, annual_holding
                ),
            }
        )
        .withColumns(
            {
                "stockout_risk": F.when(stock.isNull() | F.col("reorder_point").isNull(), "UNKNOWN")
                .when(stock < F.col("reorder_point"), "HIGH")
                .otherwise("LOW"),
                "days_until_stockout": F.when(
                    stock.isNotNull() & daily.isNotNull(),
                    F.when(daily > 0, stock / daily).otherwise(999.0),
                ),
                "service_level": level * 100,
            }
        )
    )


def optimize(
    latest: DataFrame, inventory: DataFrame | None = None, policy: InventoryPolicy = DEFAULT
) -> DataFrame:
    """The fourteen columns of a replenishment plan, one row per store."""
    return optimal_inventory(attach_inventory(latest, inventory), policy).select(
        "Store",
        "latest_date",
        "forecast_next_30d",
        F.col("demand_volatility_30d").alias("demand_volatility"),
        "current_inventory",
        "avg_daily_demand",
        "demand_std",
        "safety_stock",
        "reorder_point",
        "optimal_order_qty",
        "economic_order_qty",
        "stockout_risk",
        "days_until_stockout",
        "service_level",
    )


def _is_high() -> Column:
    return F.col("stockout_risk") == "HIGH"


def _is_unknown() -> Column:
    return F.col("stockout_risk") == "UNKNOWN"


def _is_excess() -> Column:
    return F.col("current_inventory") > F.col("optimal_order_qty") * 2


def recommend_action(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "recommended_action",
        F.when(_is_unknown(), ACTIONS["unknown"])
        .when(_is_high(), ACTIONS["high"])
        .when(F.col("current_inventory") < F.col("safety_stock"), ACTIONS["low"])
        .when(_is_excess(), ACTIONS["excess"])
        .otherwise(ACTIONS["normal"]),
    )


def order_priority(df: DataFrame) -> DataFrame:
    """Levels 2 and 3 need stock below a level that HIGH risk already covers; NULL if unknown."""
    stock = F.col("current_inventory")
    level = (
        F.when(_is_high(), 1)
        .when(stock < F.col("safety_stock"), 2)
        .when(stock < F.col("reorder_point"), 3)
        .otherwise(4)
    )
    return df.withColumn("order_priority", F.when(~_is_unknown(), level))


def graded_priority(df: DataFrame, urgent_days: float = 7) -> DataFrame:
    """Four levels that can all occur.

    1 under a week of supply, 2 below safety stock, 3 below the reorder point, 4 enough; NULL
    where stock or forecast are unknown.
    """
    stock = F.col("current_inventory")
    level = (
        F.when(F.col("days_until_stockout") < urgent_days, 1)
        .when(stock < F.col("safety_stock"), 2)
        .when(stock < F.col("reorder_point"), 3)
        .otherwise(4)
    )
    return df.withColumn("graded_priority", F.when(~_is_unknown(), level))


def inventory_gap(df: DataFrame) -> DataFrame:
    """Shortfall to the reorder point, and stock beyond need where it is over twice the need."""
    stock = F.col("current_inventory")
    over = F.when(_is_excess(), stock - F.col("optimal_order_qty")).otherwise(0.0)
    surplus = F.when(stock.isNotNull() & F.col("optimal_order_qty").isNotNull(), over)
    return df.withColumns(
        {"inventory_gap": F.col("reorder_point") - stock, "excess_inventory": surplus}
    )


def recommend(df: DataFrame, recommended_at: Column | None = None) -> DataFrame:
    """Actions, priorities, gaps and the time of a plan."""
    steps = (recommend_action, order_priority, inventory_gap)
    for step in steps:
        df = df.transform(step)
    at = F.current_timestamp() if recommended_at is None else recommended_at
    return df.withColumn("recommendation_timestamp", at)


def impact_totals(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("Store").alias("total_stores"),
        F.sum("forecast_next_30d").alias("total_forecasted_demand"),
        F.sum("current_inventory").alias("total_current_inventory"),
        F.sum("optimal_order_qty").alias("total_optimal_inventory"),
        F.sum("safety_stock").alias("total_safety_stock"),
        F.count_if(_is_high()).alias("high_risk_stores"),
        F.count_if(_is_unknown()).alias("unknown_stores"),
        F.sum("excess_inventory").alias("total_excess_inventory"),
    )


def business_impact(
    df: DataFrame, policy: InventoryPolicy = DEFAULT, analysed_at: Column | None = None
) -> DataFrame:
    """Savings and avoided stock-outs of a plan, as one row."""
    stock, need = F.col("total_current_inventory"), F.col("total_optimal_inventory")
    demand = F.col("total_forecasted_demand")
    reduction = stock - need
    monthly = reduction * policy.holding_cost_per_month
    prevented = (policy.stockout_rate_today - (1 - policy.service_level)) * demand
    avoided = prevented * policy.stockout_cost
    at = F.current_timestamp() if analysed_at is None else analysed_at
    return impact_totals(df).select(
        at.alias("analysis_date"),
        "total_stores",
        demand.alias("forecasted_demand_30d"),
        stock.alias("current_inventory"),
        need.alias("optimal_inventory"),
        reduction.alias("inventory_reduction_units"),
        (F.try_divide(reduction, stock) * 100).alias("inventory_reduction_pct"),
        monthly.alias("monthly_holding_cost_savings"),
        (monthly * 12).alias("annual_holding_cost_savings"),
        "high_risk_stores",
        "unknown_stores",
        prevented.alias("stockouts_prevented"),
        avoided.alias("stockout_cost_savings"),
        (monthly * 12 + avoided).alias("total_annual_roi"),
        F.lit(policy.service_level * 100).alias("service_level_target"),
        F.lit(policy.lead_time_days).cast("bigint").alias("lead_time_days"),
    )


def urgent(df: DataFrame, n: int = 20) -> DataFrame:
    """The n stores at high risk that run out first."""
    return (
        df.filter(_is_high())
        .select(
            "Store",
            "current_inventory",
            "reorder_point",
            "optimal_order_qty",
            "days_until_stockout",
            "recommended_action",
        )
        .orderBy("days_until_stockout", "Store")
        .limit(n)
    )
