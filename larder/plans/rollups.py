"""Reports from stored sums: each batch of predictions is added up once, and reports add the sums.

A rollup has a row per store and week, so reports over years of batches read rows in proportion to
stores and weeks, not to days. Stores are counted by their keys, which the rollup keeps: the count
is exact. Store it with :func:`larder.sources.tables.append_batch`, and a batch that is
corrected or tried again replaces its own sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.params import PRIMARY_MODEL

KEYS = ("Store", "week_start")
SUMS = (
    "rows", "actual", "actual_n", "predicted", "predicted_n", "percentage", "percentage_n",
    "absolute_error",
)


def partials(predictions: DataFrame, model: str = PRIMARY_MODEL) -> DataFrame:
    """Sums and counts of one batch of predictions, per store and week, which starts on Monday."""
    actual, predicted = F.col("actual_sales"), F.col(f"predicted_sales_{model}")
    percentage, error = F.col(f"percentage_error_{model}"), F.col(f"error_{model}")
    return predictions.groupBy(
        "Store", F.date_trunc("week", "Date").cast("date").alias("week_start")
    ).agg(
        F.count("*").alias("rows"),
        F.sum(actual).alias("actual"),
        F.count(actual).alias("actual_n"),
        F.sum(predicted).alias("predicted"),
        F.count(predicted).alias("predicted_n"),
        F.sum(percentage).alias("percentage"),
        F.count(percentage).alias("percentage_n"),
        F.sum(F.abs(error)).alias("absolute_error"),
    )


def merge(rollup: DataFrame) -> DataFrame:
    """One row per store and week from the sums of several batches, themselves mergeable again."""
    return rollup.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])


def _mean(name: str) -> Column:
    return F.try_divide(F.sum(name), F.sum(f"{name}_n"))


def kpi_summary(rollup: DataFrame) -> DataFrame:
    """As :func:`larder.plans.reports.kpi_summary` over all predictions of the batches."""
    return rollup.agg(
        F.countDistinct("Store").alias("total_stores"),
        _mean("percentage").alias("avg_forecast_accuracy_pct"),
        (100 - _mean("percentage")).alias("forecast_accuracy_score"),
        F.sum("actual").alias("total_actual_sales"),
        F.sum("predicted").alias("total_predicted_sales"),
        F.sum("absolute_error").alias("total_absolute_error"),
    ).withColumn("report_date", F.current_date())


def accuracy_by_type(rollup: DataFrame, stores: DataFrame) -> DataFrame:
    """As :func:`larder.plans.reports.accuracy_by_type`; sums are added per store before the join."""
    per_store = rollup.groupBy("Store").agg(*[F.sum(c).alias(c) for c in SUMS])
    return (
        per_store.join(stores.select("Store", "StoreType", "Assortment"), "Store")
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


def weekly_trend(rollup: DataFrame) -> DataFrame:
    """As :func:`larder.plans.reports.weekly_trend`."""
    return (
        rollup.groupBy("week_start")
        .agg(
            F.sum("actual").alias("total_actual_sales"),
            F.sum("predicted").alias("total_predicted_sales"),
            _mean("percentage").alias("weekly_mape"),
            F.sum("rows").alias("prediction_count"),
        )
        .orderBy("week_start")
    )
