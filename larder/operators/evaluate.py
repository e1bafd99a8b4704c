"""Training sets, error measures, model comparison and the run log."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.functions.columns import to_rows
from larder.operators.analysis import key_digest
from larder.params import MAPE_TARGET, PRIMARY_MODEL, SALES_KEY


def model_matrix(
    df: DataFrame,
    features: Sequence[str],
    target: str = "Sales",
    keys: Sequence[str] = SALES_KEY,
) -> DataFrame:
    """Keys, target and the listed features, with missing feature values as 0."""
    filled = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features]
    return df.select(*keys, F.col(target).cast("double").alias(target), *filled)


def split_date(df: DataFrame, date: str = "Date", fraction: float = 0.8) -> DataFrame:
    """One row ``cut``: the first date of the newest part of the rows.

    Rows are counted per date first; the running total is over those counts, one per calendar
    day, and so fits in a single task whatever the size of ``df``. A date is never torn apart:
    it belongs to the older part only if all its rows lie within the leading ``fraction``.
    """
    per_date = df.filter(F.col(date).isNotNull()).groupBy(date).agg(F.count("*").alias("n"))
    running = per_date.select(
        date,
        F.sum("n").over(Window.orderBy(date)).alias("upto"),
        F.sum("n").over(Window.partitionBy()).alias("total"),
    )
    older = F.col("upto") <= F.floor(F.col("total") * F.lit(fraction))
    return running.agg(F.min(F.when(~older, F.col(date))).alias("cut"))


def time_split(
    df: DataFrame, date: str = "Date", fraction: float = 0.8
) -> tuple[DataFrame, DataFrame]:
    """Oldest rows to train on and newest rows to test on, without sorting the rows."""
    cut = split_date(df, date, fraction).scalar()
    return df.filter(F.col(date) < cut), df.filter(F.col(date) >= cut)


def _measures(actual: Column, predicted: Column) -> dict[str, Column]:
    error = actual - predicted
    both = actual.isNotNull() & predicted.isNotNull()
    squared = F.sum(error * error)
    spread = F.var_pop(F.when(both, actual)) * F.count_if(both)
    return {
        "MAE": F.avg(F.abs(error)),
        "RMSE": F.sqrt(F.avg(error * error)),
        "R_square": 1 - F.try_divide(squared, spread),
        "MAPE_percent": F.avg(F.abs(error) / F.when(actual != 0, F.abs(actual))) * 100,
    }


def metrics(
    df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()
) -> DataFrame:
    """MAE, RMSE, R-square and MAPE of a prediction, overall or per group, from one pass.

    Days without sales do not count towards MAPE.
    """
    measures = _measures(F.col(actual), F.col(predicted))
    return df.groupBy(*by).agg(
        F.count(F.col(actual) + F.col(predicted)).alias("rows"),
        *[c.alias(name) for name, c in measures.items()],
    )


def predict_moving_average(
    df: DataFrame, k: int = 30, name: str = "predicted_sales_baseline"
) -> DataFrame:
    """The mean of the k preceding rows as the forecast."""
    return df.withColumn(name, F.col(f"rolling_mean_{k}"))


def add_errors(
    df: DataFrame, model: str = PRIMARY_MODEL, actual: str = "actual_sales"
) -> DataFrame:
    """Signed, absolute and percentage error; no percentage where the actual value is 0."""
    error = F.col(actual) - F.col(f"predicted_sales_{model}")
    return df.withColumns(
        {
            f"error_{model}": error,
            f"absolute_error_{model}": F.abs(error),
            f"percentage_error_{model}": F.try_divide(F.abs(error), F.col(actual)) * 100,
        }
    )


def residuals(
    df: DataFrame, actual: str, predicted: str, keys: Sequence[str] = SALES_KEY, n: int = 1000
) -> DataFrame:
    """A repeatable sample of n predictions with their residuals."""
    return (
        df.select(
            *keys,
            F.col(actual).alias("actual_sales"),
            F.col(predicted).alias("predicted_sales"),
            (F.col(actual) - F.col(predicted)).alias("residual"),
        )
        .orderBy(key_digest(keys), *keys)
        .limit(n)
    )


def compare_models(df: DataFrame, actual: str, predictions: Mapping[str, str]) -> DataFrame:
    """One row of measures per model from one pass over a table of side-by-side predictions."""
    sets = {
        model: _measures(F.col(actual), F.col(predicted))
        for model, predicted in predictions.items()
    }
    one_row = df.agg(
        *[c.alias(f"{m} {name}") for m, measures in sets.items() for name, c in measures.items()]
    )
    return to_rows(
        one_row,
        [
            {"Model": F.lit(m)} | {name: F.col(f"`{m} {name}`") for name in measures}
            for m, measures in sets.items()
        ],
    )


def best(comparison: DataFrame, measure: str = "MAPE_percent") -> DataFrame:
    """The model with the lowest measure (the first by name among equals) and the verdict on it."""
    columns = [c for c in comparison.columns if c not in (measure, "Model")]
    lowest = F.min(F.when(F.col(measure).isNotNull(), F.struct(measure, "Model", *columns)))
    return comparison.agg(lowest.alias("top")).select(
        *[F.col("top")[c].alias(c) for c in comparison.columns],
        F.when(F.col("top")[measure] < MAPE_TARGET, "YES").otherwise("NO").alias("target_met"),
    )


def log_run(
    spark: SparkSession,
    name: str,
    params: Mapping[str, object],
    metrics: Mapping[str, float],
    logged_at: datetime,
) -> DataFrame:
    """One row for a model run, to be appended to a log table."""
    row = (name, {k: str(v) for k, v in params.items()}, dict(metrics), logged_at)
    return spark.createDataFrame(
        [row],
        "run string, params map<string,string>, metrics map<string,double>, logged_at timestamp",
    )
