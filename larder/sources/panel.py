"""A store-day panel derived from order lines and suppliers.

Suppliers stand for stores and ship dates for trading days. The panel holds one row per store and
day, so the rows of a store are bounded by the days of the calendar however many order lines a
single supplier may have. Small tables are combined on the map side before they are shuffled; large
ones are dealt out by store and day first, where a task holds a row for each, not its lines.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Order lines per task, from so many lines on. Spark puts small shuffle partitions together by their
# packed bytes, of which a task's tables in memory hold over twenty times as many.
LINES_A_TASK, MANY_LINES = 200_000, 2_000_000


def tasks(spark: SparkSession, sf_dir: str) -> int:
    """How many tasks share the order lines, by their number; 0 where Spark may choose."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    return math.ceil(lines / LINES_A_TASK) if lines >= MANY_LINES else 0


def dealt(df: DataFrame, parts: int, *keys: str) -> DataFrame:
    """Rows dealt out by their keys in ``parts`` partitions, if any, which later steps rest on."""
    return df.repartition(parts, *keys) if parts else df


def store_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean panel: Store, Date, Sales, Customers, Promo. Sales are multiples of 1/8."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_suppkey").cast("int").alias("Store"),
        F.col("l_shipdate").cast("date").alias("Date"),
        "l_extendedprice",
        "l_quantity",
        "l_discount",
    )
    return dealt(lines, tasks(spark, sf_dir), "Store", "Date").groupBy("Store", "Date").agg(
        (F.sum(F.round("l_extendedprice").cast("bigint")).cast("double") / 8).alias("Sales"),
        F.sum(F.col("l_quantity").cast("bigint")).cast("int").alias("Customers"),
        F.max(F.when(F.col("l_discount") >= 0.08, 1).otherwise(0)).alias("Promo"),
    )


def _every(code: Column, n: int) -> Column:
    return code % n == 0


def raw_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel with the faults a raw sales file has: NULL, negative, closed-day and repeated rows."""
    date = F.col("Date")
    code = (
        F.col("Store") * 31 + F.year(date) * 372 + F.month(date) * 31 + F.dayofmonth(date)
    )
    month, day = F.month(date), F.dayofmonth(date)
    faulty = store_days(spark, sf_dir).select(
        "Store",
        F.expr("extract(dayofweek_iso FROM Date)").cast("int").alias("DayOfWeek"),
        date,
        F.when(_every(code, 211), F.lit(None).cast("double"))
        .when(_every(code, 223), -F.col("Sales"))
        .when(_every(code, 97), F.lit(0.0))
        .otherwise(F.col("Sales"))
        .alias("Sales"),
        F.when(_every(code, 97), 0).otherwise(F.col("Customers")).alias("Customers"),
        F.when(_every(code, 97) | _every(code, 227), 0)
        .when(_every(code, 229), F.lit(None).cast("int"))
        .otherwise(1)
        .alias("Open"),
        "Promo",
        F.when((month == 12) & day.isin(25, 26), "c")
        .when((month == 4) & (day <= 4), "b")
        .when(month.isin(1, 5, 10) & (day == 1), "a")
        .otherwise("0")
        .alias("StateHoliday"),
        F.when(month.isin(7, 8), 1).otherwise(0).alias("SchoolHoliday"),
        F.when(_every(code, 101), 2).otherwise(1).alias("copies"),
    )
    copies = F.explode(F.sequence(F.lit(1), F.col("copies")))
    return faulty.withColumn("copy", copies).drop("copies", "copy")


def raw_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store dimension with padded codes and missing competition and promotion data."""
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    key = F.col("s_suppkey")
    on_promo2 = key % 2 == 1
    opening_known = ~(key % 10).isin(3, 7)
    return suppliers.select(
        key.cast("int").alias("Store"),
        F.concat(
            F.lit(" "), F.substring(F.lit("abcd"), (F.col("s_nationkey") % 4 + 1).cast("int"), 1)
        ).alias("StoreType"),
        F.substring(F.lit("abc"), (key % 3 + 1).cast("int"), 1).alias("Assortment"),
        F.when(key % 10 != 7, ((key * 1370) % 15000 + 50).cast("double")).alias(
            "CompetitionDistance"
        ),
        F.when(opening_known, (key % 12 + 1).cast("int")).alias("CompetitionOpenSinceMonth"),
        F.when(opening_known, (1990 + key % 9).cast("int")).alias("CompetitionOpenSinceYear"),
        (key % 2).cast("int").alias("Promo2"),
        F.when(on_promo2, (key % 52 + 1).cast("int")).alias("Promo2SinceWeek"),
        F.when(on_promo2, (1996 + key % 4).cast("int")).alias("Promo2SinceYear"),
        F.when(on_promo2, F.lit("Jan,Apr,Jul,Oct")).alias("PromoInterval"),
    )
