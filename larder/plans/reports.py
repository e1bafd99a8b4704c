"""Dashboard queries over predictions, stores, features and recommendations.

``model`` is the suffix of the prediction columns a report reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.columns import first_below, to_rows
from larder.params import PRIMARY_MODEL, InventoryPolicy

# Labels of the competition report, by distance in metres.
DISTANCE_BANDS = [
    (1000, "Very Close (<1km)"),
    (5000, "Close (1-5km)"),
    (10000, "Moderate (5-10km)"),
]
FAR = "Far (>10km)"
# Labels of the promotion report.
PROMO_LABELS = {1: "With Promotion", 0: "No Promotion"}


def _predicted(model: str) -> str:
    return f"predicted_sales_{model}"


def _percentage(model: str) -> str:
    return f"percentage_error_{model}"


def _money(value: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(F.round(value, 2), 2))  # half a cent goes up


def kpi_summary(predictions: DataFrame, model: str = PRIMARY_MODEL) -> DataFrame:
    return predictions.agg(
        F.countDistinct("Store").alias("total_stores"),
        F.avg(_percentage(model)).alias("avg_forecast_accuracy_pct"),
        (100 - F.avg(_percentage(model))).alias("forecast_accuracy_score"),
        F.sum("actual_sales").alias("total_actual_sales"),
        F.sum(_predicted(model)).alias("total_predicted_sales"),
        F.sum(F.abs(F.col(f"error_{model}"))).alias("total_absolute_error"),
    ).withColumn("report_date", F.current_date())


def kpi_cards(summary: DataFrame) -> DataFrame:
    """Three formatted headline figures."""
    score = F.round("forecast_accuracy_score", 2).cast("string")
    cards = {
        "Total Stores": F.col("total_stores").cast("string"),
        "Forecast Accuracy": F.concat(score, F.lit("%")),
        "Total Sales (Test Period)": _money(F.col("total_actual_sales")),
    }
    return to_rows(
        summary, [{"metric": F.lit(metric), "value": value} for metric, value in cards.items()]
    )


def top_accurate(predictions: DataFrame, model: str = PRIMARY_MODEL, n: int = 20) -> DataFrame:
    """The n stores forecast best."""
    return (
        predictions.filter(F.col("actual_sales") > 0)
        .groupBy("Store")
        .agg(
            F.count("*").alias("prediction_count"),
            F.avg(_predicted(model)).alias("avg_predicted_sales"),
            F.avg("actual_sales").alias("avg_actual_sales"),
            F.avg(_percentage(model)).alias("avg_mape"),
            (100 - F.avg(_percentage(model))).alias("accuracy_score"),
        )
        .orderBy("avg_mape", "Store")
        .limit(n)
    )


def _per_store(predictions: DataFrame, model: str) -> DataFrame:
    """Sums and counts per store: the join with the store table then moves stores, not days."""
    percentage = F.col(_percentage(model))
    return predictions.groupBy("Store").agg(
        F.sum("actual_sales").alias("actual"),
        F.count("actual_sales").alias("actual_n"),
        F.sum(_predicted(model)).alias("predicted"),
        F.count(_predicted(model)).alias("predicted_n"),
        F.sum(percentage).alias("percentage"),
        F.count(percentage).alias("percentage_n"),
    )


def _mean(name: str) -> Column:
    return F.try_divide(F.sum(name), F.sum(f"{name}_n"))


def accuracy_by_type(
    predictions: DataFrame, stores: DataFrame, model: str = PRIMARY_MODEL
) -> DataFrame:
    """Accuracy and volume per store type and assortment."""
    kinds = stores.select("Store", "StoreType", "Assortment")
    return (
        _per_store(predictions, model)
        .join(kinds, "Store")
        .groupBy("StoreType", "Assortment")
        .agg(
            F.countDistinct("Store").alias("store_count"),
            _mean("percentage").alias("avg_mape"),
            _mean("actual").alias("avg_actual_sales"),
            _mean("predicted").alias("avg_predicted_sales"),
            F.sum("actual").alias("total_actual_sales"),
            F.sum("predicted").alias("total_predicted_sales"),
        )
        .orderBy("avg_mape", "StoreType", "Assortment")
    )


def stockout_alerts(recommendations: DataFrame, n: int = 50) -> DataFrame:
    gap = F.col("reorder_point") - F.col("current_inventory")
    return (
        recommendations.filter(F.col("stockout_risk") == "HIGH")
        .orderBy("days_until_stockout", "Store")
        .limit(n)
        .select(
            "Store",
            "current_inventory",
            "reorder_point",
            "optimal_order_qty",
            F.round("days_until_stockout", 1).alias("days_until_stockout"),
            F.round(gap, 0).alias("inventory_gap"),
            "recommended_action",
            F.round("forecast_next_30d", 0).alias("forecast_next_30d"),
        )
    )


def _savings(recommendations: DataFrame, policy: InventoryPolicy) -> DataFrame:
    surplus = F.col("current_inventory") - F.col("optimal_order_qty")
    monthly = surplus * policy.holding_cost_per_month
    return recommendations.filter(surplus > 0).select(
        "Store",
        F.round("current_inventory", 0).alias("current_inventory"),
        F.round("optimal_order_qty", 0).alias("optimal_inventory"),
        F.round(surplus, 0).alias("inventory_reduction"),
        F.round(monthly, 2).alias("monthly_savings"),
        F.round(monthly * 12, 2).alias("annual_savings"),
        "stockout_risk",
    )


def savings_by_store(
    recommendations: DataFrame, policy: InventoryPolicy = InventoryPolicy()
) -> DataFrame:
    """What each overstocked store would save."""
    return _savings(recommendations, policy).orderBy(F.desc("annual_savings"), "Store")


def savings_total(
    recommendations: DataFrame, policy: InventoryPolicy = InventoryPolicy()
) -> DataFrame:
    """The savings of all stores together, summed without sorting them first."""
    return _savings(recommendations, policy).agg(
        F.sum("annual_savings").alias("total_annual_savings"),
        F.avg("annual_savings").alias("avg_savings_per_store"),
        F.count("*").alias("stores_with_savings"),
    )


def weekly_trend(predictions: DataFrame, model: str = PRIMARY_MODEL) -> DataFrame:
    """Actual and predicted sales per week, which starts on Monday."""
    return (
        predictions.groupBy(F.date_trunc("week", "Date").cast("date").alias("week_start"))
        .agg(
            F.sum("actual_sales").alias("total_actual_sales"),
            F.sum(_predicted(model)).alias("total_predicted_sales"),
            F.avg(_percentage(model)).alias("weekly_mape"),
            F.count("*").alias("prediction_count"),
        )
        .orderBy("week_start")
    )


def importance_rank(importance: DataFrame, n: int = 15) -> DataFrame:
    """Features ranked by importance. One task ranks them: there is one row per feature."""
    rank = F.rank().over(Window.orderBy(F.desc("importance")))
    return (
        importance.select("feature", "importance", rank.alias("importance_rank"))
        .orderBy(F.desc("importance"), "feature")
        .limit(n)
    )


def promo_analysis(predictions: DataFrame, model: str = PRIMARY_MODEL) -> DataFrame:
    """Sales with and without promotion. Unknown promotion forms a group of its own, under the
    same label as none.

    The predictions carry ``Promo`` and ``sales_per_customer`` along, so nothing is joined.
    """
    status = F.when(F.col("Promo") == 1, PROMO_LABELS[1]).otherwise(PROMO_LABELS[0])
    return (
        predictions.filter(F.col("actual_sales") > 0)
        .groupBy("Promo")
        .agg(
            F.count("*").alias("days_count"),
            F.avg("actual_sales").alias("avg_daily_sales"),
            F.avg(_predicted(model)).alias("avg_predicted_sales"),
            F.avg("sales_per_customer").alias("avg_sales_per_customer"),
        )
        .withColumn("promo_status", status)
        .drop("Promo")
    )


def stored_views(policy: InventoryPolicy = InventoryPolicy(), model: str = PRIMARY_MODEL) -> dict[str, str]:
    """The reports that other sessions read, as queries for stored views over the job's tables."""
    predicted, percentage = _predicted(model), _percentage(model)
    surplus = "current_inventory - optimal_order_qty"
    monthly = f"({surplus}) * {policy.holding_cost_per_month}D"
    return {
        "kpi_summary": f"""
            SELECT count(DISTINCT Store) AS total_stores, avg({percentage}) AS avg_forecast_accuracy_pct,
                   100 - avg({percentage}) AS forecast_accuracy_score,
                   sum(actual_sales) AS total_actual_sales, sum({predicted}) AS total_predicted_sales,
                   sum(abs(error_{model})) AS total_absolute_error, current_date() AS report_date
            FROM ml.demand_predictions""",
        "accuracy_by_store_type": f"""
            SELECT StoreType, Assortment, count(DISTINCT p.Store) AS store_count,
                   avg({percentage}) AS avg_mape, avg(actual_sales) AS avg_actual_sales,
                   avg({predicted}) AS avg_predicted_sales, sum(actual_sales) AS total_actual_sales,
                   sum({predicted}) AS total_predicted_sales
            FROM ml.demand_predictions p JOIN silver.cleaned_stores s ON p.Store = s.Store
            GROUP BY StoreType, Assortment""",
        "savings_by_store": f"""
            SELECT Store, round(current_inventory, 0) AS current_inventory,
                   round(optimal_order_qty, 0) AS optimal_inventory,
                   round({surplus}, 0) AS inventory_reduction, round({monthly}, 2) AS monthly_savings,
                   round({monthly} * 12, 2) AS annual_savings, stockout_risk
            FROM ml.inventory_recommendations WHERE {surplus} > 0""",
        "promo_effectiveness": f"""
            SELECT CASE WHEN Promo = 1 THEN '{PROMO_LABELS[1]}' ELSE '{PROMO_LABELS[0]}' END AS promo_status,
                   count(*) AS days_count, avg(actual_sales) AS avg_daily_sales,
                   avg({predicted}) AS avg_predicted_sales,
                   avg(sales_per_customer) AS avg_sales_per_customer
            FROM ml.demand_predictions WHERE actual_sales > 0 GROUP BY Promo""",
    }


def competition_impact(
    predictions: DataFrame, stores: DataFrame, model: str = PRIMARY_MODEL
) -> DataFrame:
    """Sales and error per distance band."""
    band = first_below(F.col("CompetitionDistance"), DISTANCE_BANDS, otherwise=FAR)
    return (
        _per_store(predictions, model)
        .join(stores.select("Store", band.alias("competition_proximity")), "Store")
        .groupBy("competition_proximity")
        .agg(
            F.countDistinct("Store").alias("store_count"),
            _mean("actual").alias("avg_daily_sales"),
            _mean("percentage").alias("avg_forecast_error"),
        )
        .orderBy(F.desc("avg_daily_sales"), "competition_proximity")
    )


def impact_latest(impact: DataFrame) -> DataFrame:
    """The newest impact row, formatted."""
    tied = [F.desc("total_stores"), F.desc("total_annual_roi")]
    return (
        impact.orderBy(F.desc("analysis_date"), *tied)
        .limit(1)
        .select(
            "analysis_date",
            "total_stores",
            F.round("forecasted_demand_30d", 0).alias("forecasted_demand"),
            F.round("inventory_reduction_units", 0).alias("inventory_reduced_units"),
            F.round("inventory_reduction_pct", 1).alias("inventory_reduced_pct"),
            _money(F.col("monthly_holding_cost_savings")).alias("monthly_savings"),
            _money(F.col("annual_holding_cost_savings")).alias("annual_savings"),
            "high_risk_stores",
            F.round("stockouts_prevented", 0).alias("stockouts_prevented"),
            _money(F.col("stockout_cost_savings")).alias("stockout_savings"),
            _money(F.col("total_annual_roi")).alias("total_annual_roi"),
        )
    )
