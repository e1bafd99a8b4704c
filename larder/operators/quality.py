"""Profiling and data-quality checks.

Every check is one aggregation. Where a check needs the duplicates of a key, rows are first
counted per key, which combines on the map side, so a key with very many copies costs one row
per map task in the shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.columns import pass_fail, to_rows
from larder.params import SALES_KEY


def profile(
    sales: DataFrame,
    stores: DataFrame,
    key: str = "Store",
    date: str = "Date",
    measure: str = "Sales",
) -> DataFrame:
    """Size and extent of the raw tables as (metric, value) text rows."""
    facts = sales.agg(
        F.count("*").alias("records"),
        F.countDistinct(key).alias("keys"),
        F.min(date).alias("first"),
        F.max(date).alias("last"),
        F.countDistinct(date).alias("days"),
        F.max(measure).alias("peak"),
    )
    dimension = stores.agg(F.count("*").alias("n")).scalar()
    values = {
        "Total Sales Records": F.col("records"),
        "Total Stores": F.col("total_stores"),
        "Unique Stores in Sales": F.col("keys"),
        "Date Range Start": F.col("first"),
        "Date Range End": F.col("last"),
        "Total Days": F.col("days"),
        "Max Daily Sales": F.col("peak"),
    }
    return to_rows(
        facts.withColumn("total_stores", dimension),
        [{"metric": F.lit(m), "value": v.cast("string")} for m, v in values.items()],
    )


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per table."""
    counts = [
        df.agg(F.count("*").alias("record_count")).select(
            F.lit(name).alias("table_name"), "record_count"
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """NULLs per column, as one row."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns or df.columns])


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Typed count, mean, standard deviation, least and greatest value per column."""
    stats = {"count": F.count, "mean": F.avg, "stddev": F.stddev_samp, "min": F.min, "max": F.max}
    one_row = df.agg(
        *[f(c).alias(f"{stat} of {c}") for c in columns for stat, f in stats.items()]
    )
    return to_rows(
        one_row,
        [
            {"column": F.lit(c)}
            | {
                stat: F.col(f"`{stat} of {c}`").cast("bigint" if stat == "count" else "double")
                for stat in stats
            }
            for c in columns
        ],
    )


def freq(df: DataFrame, column: str, by: str = "key") -> DataFrame:
    """Rows per value, ordered by the value or (``by="count"``) by falling count."""
    counts = df.groupBy(column).agg(F.count("*").alias("count"))
    return counts.orderBy(F.desc("count"), column) if by == "count" else counts.orderBy(column)


def sales_by_weekday(df: DataFrame) -> DataFrame:
    return (
        df.groupBy(F.col("DayOfWeek").cast("int").alias("DayOfWeek"))
        .agg(
            F.avg("Sales").alias("avg_sales"),
            F.sum("Sales").alias("total_sales"),
            F.count("*").alias("num_records"),
        )
        .orderBy("DayOfWeek")
    )


def closed_with_sales(df: DataFrame) -> Column:
    return (df["Open"] == 0) & (df["Sales"] > 0)


def violations(df: DataFrame, keys: Sequence[str] = SALES_KEY) -> DataFrame:
    """Broken rules of a raw sales table, each with its count and PASS or ATTENTION."""
    rules = {
        "Records with Sales=0 when Open=1": (F.col("Open") == 1) & (F.col("Sales") == 0),
        "Records with Sales>0 when Open=0": closed_with_sales(df),
        "Records with negative Sales": F.col("Sales") < 0,
        "Records with null Sales": F.col("Sales").isNull(),
    }
    names = [f"rule_{i}" for i in range(len(rules))]
    per_key = df.groupBy(*keys).agg(
        F.count("*").alias("rows"),
        *[F.count_if(rule).alias(n) for n, rule in zip(names, rules.values())],
    )
    totals = per_key.agg(
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names],
        F.count_if(F.col("rows") > 1).alias("repeated"),
    )
    checks = dict(zip(rules, names)) | {"Duplicate Store-Date combinations": "repeated"}
    return to_rows(
        totals,
        [
            {
                "check_name": F.lit(text),
                "violations": F.col(n),
                "status": pass_fail(F.col(n) == 0, "ATTENTION"),
            }
            for text, n in checks.items()
        ],
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str] = SALES_KEY) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")


def coverage(df: DataFrame, date: str = "Date") -> DataFrame:
    """First and last date, distinct dates, span in days and days missing within the span."""
    return (
        df.agg(
            F.min(date).alias("start_date"),
            F.max(date).alias("end_date"),
            F.countDistinct(date).alias("unique_dates"),
        )
        .withColumn("coverage_days", F.datediff("end_date", "start_date"))
        .withColumn("missing_days", F.col("coverage_days") + 1 - F.col("unique_dates"))
    )


def check_columns(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Whether each expected column exists, and how many of its values are filled."""
    present = [c for c in expected if c in df.columns]
    filled = df.agg(*[F.count(c).alias(c) for c in present], F.lit(0).alias("absent"))
    return to_rows(
        filled,
        [
            {
                "column_name": F.lit(c),
                "status": F.lit("PRESENT" if c in present else "MISSING"),
                "filled_rows": F.col(c if c in present else "absent").cast("bigint"),
            }
            for c in expected
        ],
    )


def check_types(df: DataFrame, expected: Mapping[str, str]) -> DataFrame:
    """Declared against actual type per column, with the number of filled values."""
    actual = dict(df.dtypes)
    present = [c for c in expected if c in actual]
    filled = df.agg(*[F.count(c).alias(c) for c in present], F.lit(0).alias("absent"))
    return to_rows(
        filled,
        [
            {
                "column_name": F.lit(c),
                "expected_type": F.lit(kind),
                "actual_type": F.lit(actual.get(c)).cast("string"),
                "status": F.lit("PASS" if actual.get(c) == kind else "FAIL"),
                "filled_rows": F.col(c if c in present else "absent").cast("bigint"),
            }
            for c, kind in expected.items()
        ],
    )


def quality_metrics(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count_if(closed_with_sales(df)).alias("closed_with_sales"),
        F.count_if(F.col("Sales") < 0).alias("negative_sales"),
        F.avg("Sales").alias("avg_sales"),
        F.stddev_samp("Sales").alias("stddev_sales"),
    )


def bronze_summary(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("total_records"),
        F.countDistinct("Store").alias("unique_stores"),
        F.min("Date").alias("start_date"),
        F.max("Date").alias("end_date"),
        F.avg("Sales").alias("avg_sales"),
    )


def ranges(df: DataFrame, columns: Sequence[str], non_negative: str | None = None) -> DataFrame:
    """Least and greatest value per column, as one row, with a verdict on ``non_negative``."""
    extremes = [
        f(c).alias(f"{stat}_{c}") for c in columns for stat, f in (("min", F.min), ("max", F.max))
    ]
    row = df.agg(*extremes)
    if non_negative is None:
        return row
    return row.withColumn("status", pass_fail(F.col(f"min_{non_negative}") >= 0))


def orphans(fact: DataFrame, dimension: DataFrame, key: str = "Store") -> DataFrame:
    """Keys of the fact table that the dimension lacks."""
    return fact.select(key).distinct().join(dimension.select(key).distinct(), key, "left_anti")


def invalid_open_sales(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if(closed_with_sales(df)).alias("violations")).withColumn(
        "status", pass_fail(F.col("violations") == 0)
    )


def quality_report(
    tables: Mapping[str, DataFrame], validated_at: datetime, status: str = "cleaned"
) -> DataFrame:
    return row_counts(tables).withColumns(
        {
            "quality_status": F.lit(status),
            "validated_at": F.lit(validated_at).cast("timestamp"),
        }
    )


def check_report(failures: Mapping[str, DataFrame], checked_at: datetime) -> DataFrame:
    """A row per check: how many rows of its failures there are, and whether there are none."""
    counted = [
        df.agg(F.count("*").alias("failures")).select(
            F.lit(name).alias("check_name"),
            "failures",
            pass_fail(F.col("failures") == 0).alias("status"),
            F.lit(checked_at).cast("timestamp").alias("checked_at"),
        )
        for name, df in failures.items()
    ]
    return reduce(DataFrame.unionByName, counted)


def critical_nulls(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULLs and verdict per column, and whether all columns passed."""
    all_filled = reduce(lambda a, b: a & b, [F.col(c) == 0 for c in columns])
    return to_rows(
        null_counts(df, columns),
        [
            {
                "feature": F.lit(c),
                "null_count": F.col(c),
                "status": pass_fail(F.col(c) == 0),
                "all_pass": all_filled,
            }
            for c in columns
        ],
    )


def validation_report(df: DataFrame, critical: Sequence[str], validated_at: datetime) -> DataFrame:
    """Column count, row count and NULL verdict as text results."""
    counts = df.agg(
        F.count("*").alias("rows"),
        F.sum(
            reduce(lambda a, b: a + b, [F.col(c).isNull().cast("bigint") for c in critical])
        ).alias("nulls"),
    )
    results = {
        "Feature Count": F.lit(str(len(df.columns))),
        "Record Count": F.col("rows").cast("string"),
        "Null Check Status": pass_fail(F.coalesce("nulls", F.lit(0)) == 0),
    }
    return to_rows(
        counts,
        [
            {
                "check_name": F.lit(name),
                "result": value,
                "validated_at": F.lit(validated_at).cast("timestamp"),
            }
            for name, value in results.items()
        ],
    )
