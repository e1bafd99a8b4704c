from datetime import date

import pytest
from conftest import SF, plan_of
from pyspark.sql import functions as F

from larder.operators import inventory
from larder.plans import reports, rollups
from larder.sources import panel, tables


def predictions(spark):
    days = panel.store_days(spark, SF)
    sales = F.when(F.col("Store") != 3, F.col("Sales"))
    guess = F.when(F.dayofmonth("Date") != 4, F.col("Sales") * 0.9 + F.col("Store"))
    error = sales - guess
    return days.select(
        "Store", "Date", sales.alias("actual_sales"), guess.alias("predicted_sales_boosted"),
        error.alias("error_boosted"), (F.abs(error) / F.nullif(sales, F.lit(0)) * 100).alias("percentage_error_boosted"),
    )


def same(a, b):
    a, b = (sorted(map(tuple, df.drop("report_date").collect()), key=str) for df in (a, b))
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for v, w in zip(x, y):
            assert v == (pytest.approx(w, rel=1e-9) if isinstance(w, float) else w)


def test_merged_sums_say_what_the_reports_say(spark):
    rows = tables.materialize(predictions(spark))
    parts = [rows.filter(F.col("Store") % 2 == k) for k in (0, 1)] + [rows.limit(0)]
    stored = None
    for batch, part in zip("abc", parts):
        sums = rollups.partials(part).withColumn("batch", F.lit(batch))
        stored = tables.append_batch(sums, "t_rollup", "batch")
    stores = panel.raw_stores(spark, SF)
    for rollup in (stored, rollups.merge(stored), rollups.merge(rollups.merge(stored))):
        same(rollups.kpi_summary(rollup), reports.kpi_summary(rows))
        same(rollups.weekly_trend(rollup), reports.weekly_trend(rows))
        same(rollups.accuracy_by_type(rollup, stores), reports.accuracy_by_type(rows, stores))
    weeks = rows.select("Store", F.date_trunc("week", "Date")).distinct().count()
    assert stored.count() == weeks


def test_a_corrected_batch_replaces_its_sums(spark):
    rows = predictions(spark)
    for part in (rows.filter("Store > 4"), rows):
        sums = rollups.partials(part).withColumn("batch", F.lit("a"))
        stored = tables.append_batch(sums, "t_rollup_again", "batch")
    same(rollups.kpi_summary(stored), reports.kpi_summary(rows))


def test_empty_rollup(spark):
    sums = rollups.partials(predictions(spark).limit(0))
    assert rollups.weekly_trend(sums).collect() == []
    summary = rollups.kpi_summary(sums).first()
    assert summary.total_stores == 0 and summary.avg_forecast_accuracy_pct is None


def test_tables_with_shared_buckets_join_on_more_keys_without_a_shuffle(spark):
    rows = spark.range(400).select(
        (F.col("id") % 9).cast("int").alias("Store"), F.date_add(F.lit(date(2020, 1, 1)), (F.col("id") / 9).cast("int")).alias("Date"),
        F.rand(1).alias("demand_volatility"), F.rand(2).alias("rolling_std_30"),
    )
    layout = {"bucket_by": (3, ["Store"]), "sort_by": ["Store", "Date"]}
    features = tables.write_table(rows.repartition(3, "Store"), "t_joined_features", **layout)
    ahead = tables.write_table(rows.select("Store", "Date").repartition(3, "Store"), "t_joined_ahead", **layout)
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with tables.on_shared_buckets(spark):
            joined = inventory.enrich(ahead, features)
            assert "Exchange" not in plan_of(joined) and "Broadcast" not in plan_of(joined)
            assert joined.count() == 400 and joined.filter("rolling_std_30 IS NULL").isEmpty()
        assert spark.conf.get(name) == before
        assert "Exchange" in plan_of(inventory.enrich(ahead, features))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
