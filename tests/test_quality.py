from datetime import datetime

from helpers import raw_rows
from pyspark.sql import functions as F

from larder import params as P
from larder.operators import quality

AT = datetime(2024, 1, 1)


def values(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_violations_counts_each_rule_and_repeated_keys(spark):
    df = raw_rows(
        spark,
        {"Sales": 0.0},
        {"Sales": 5.0, "Open": 0},
        {"Sales": -1.0, "Store": 2},
        {"Sales": None, "Store": 3},
    )
    assert list(values(quality.violations(df), "check_name", "violations").values()) == [1, 1, 1, 1, 1]
    clean = quality.violations(raw_rows(spark, {}))
    assert set(values(clean, "check_name", "status").values()) == {"PASS"}
    none = quality.violations(raw_rows(spark, {}).limit(0))
    assert set(values(none, "check_name", "violations").values()) == {0}


def test_one_key_with_very_many_copies(spark):
    df = spark.range(50000).select(
        F.lit(1).alias("Store"), F.lit("2020-01-01").alias("Date"), F.lit(1).alias("Open"),
        F.lit(0.0).alias("Sales"),
    )
    assert values(quality.violations(df), "check_name", "violations")[
        "Duplicate Store-Date combinations"
    ] == 1
    assert quality.duplicate_keys(df).first().copies == 50000


def test_profile_lists_size_and_extent(spark):
    stores = spark.createDataFrame([(1,), (2,)], "Store int")
    profile = values(
        quality.profile(raw_rows(spark, {}, {"Date": "2013-01-09", "Sales": 7.5}), stores),
        "metric", "value",
    )
    assert profile["Total Sales Records"] == "2" and profile["Total Stores"] == "2"
    assert profile["Unique Stores in Sales"] == "1" and profile["Max Daily Sales"] == "100.0"
    assert (profile["Date Range Start"], profile["Date Range End"]) == ("2013-01-03", "2013-01-09")


def test_describe_and_nulls(spark):
    df = raw_rows(spark, {"Sales": 1.0}, {"Sales": 3.0}, {"Sales": None})
    row = quality.describe(df, ["Sales"]).first()
    assert (row["count"], row["mean"], row["min"], row["max"]) == (2, 2.0, 1.0, 3.0)
    assert round(row["stddev"], 6) == 1.414214
    assert quality.null_counts(df).first().Sales == 1


def test_frequencies_and_weekdays(spark):
    df = raw_rows(spark, {"Promo": 1}, {"Promo": 1}, {"Promo": 0}, {"DayOfWeek": 2, "Sales": 50.0})
    assert [r.Promo for r in quality.freq(df, "Promo").collect()] == [0, 1]
    assert [r.DayOfWeek for r in quality.freq(df, "DayOfWeek", by="count").collect()] == [4, 2]
    first = quality.sales_by_weekday(df).first()
    assert (first.DayOfWeek, first.avg_sales, first.num_records) == (2, 50.0, 1)


def test_coverage_counts_missing_days(spark):
    df = raw_rows(spark, {"Date": "2013-01-01"}, {"Date": "2013-01-05"}).withColumn(
        "Date", F.to_date("Date")
    )
    row = quality.coverage(df).first()
    assert (row.unique_dates, row.coverage_days, row.missing_days) == (2, 4, 3)


def test_schema_checks(spark):
    df = raw_rows(spark, {}, {"Open": None})
    columns = quality.check_columns(df, ["Store", "Open", "Region"])
    assert values(columns, "column_name", "status") == {
        "Store": "PRESENT", "Open": "PRESENT", "Region": "MISSING",
    }
    assert values(columns, "column_name", "filled_rows") == {"Store": 2, "Open": 1, "Region": 0}
    types = values(quality.check_types(df, P.EXPECTED_TYPES), "column_name", "status")
    assert types == {"Store": "PASS", "Date": "FAIL", "Sales": "PASS", "Customers": "PASS"}


def test_ranges_orphans_and_business_rule(spark):
    df = raw_rows(spark, {"Sales": -1.0}, {"Store": 2, "Open": 0})
    row = quality.ranges(df, ["Sales", "Customers"], "Sales").first()
    assert (row.min_Sales, row.max_Sales, row.status) == (-1.0, 100.0, "FAIL")
    stores = spark.createDataFrame([(1,)], "Store int")
    assert [r.Store for r in quality.orphans(df, stores).collect()] == [2]
    assert quality.invalid_open_sales(df).first()[:] == (1, "FAIL")


def test_reports(spark):
    df = raw_rows(spark, {}, {"Sales": None})
    report = quality.quality_report({"Silver Sales": df}, AT).first()
    assert (report.record_count, report.quality_status, report.validated_at) == (2, "cleaned", AT)
    verdict = {r.feature: r for r in quality.critical_nulls(df, ["Store", "Sales"]).collect()}
    assert verdict["Store"].status == "PASS" and verdict["Sales"].status == "FAIL"
    assert verdict["Store"].all_pass is False
    checks = values(quality.validation_report(df, ["Sales"], AT), "check_name", "result")
    assert checks == {"Feature Count": "9", "Record Count": "2", "Null Check Status": "FAIL"}
    assert values(quality.row_counts({"a": df, "b": df}), "table_name", "record_count") == {"a": 2, "b": 2}
    metrics = quality.quality_metrics(df).first()
    assert (metrics.closed_with_sales, metrics.avg_sales) == (0, 100.0)
    assert quality.bronze_summary(df).first().total_records == 2
