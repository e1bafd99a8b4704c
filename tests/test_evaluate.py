from datetime import date, datetime, timedelta

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from larder.checks import spark_queries
from larder.operators import analysis, evaluate
from larder.sources import tables


def dated(spark, counts):
    rows = [(date(2020, 1, 1) + timedelta(days=d), i) for d, n in enumerate(counts) for i in range(n)]
    return spark.createDataFrame(rows, "Date date, i int")


def test_split_keeps_dates_whole_and_in_order(spark):
    df = dated(spark, [3, 3, 3, 1, 3, 3])
    train, test = evaluate.time_split(df)
    assert train.count() + test.count() == 16
    last, first = train.agg(F.max("Date")).first()[0], test.agg(F.min("Date")).first()[0]
    assert last < first == date(2020, 1, 5)


def test_split_with_one_date_holding_a_third_of_the_rows(spark):
    train, test = evaluate.time_split(dated(spark, [2, 2, 2, 3]))
    assert (train.count(), test.count()) == (6, 3)


def test_metrics_match_numpy_and_skip_zero_days(spark):
    y, p = [100.0, 0.0, 50.0, 80.0], [90.0, 5.0, 55.0, 100.0]
    df = spark.createDataFrame(list(zip(y, p)), "y double, p double")
    row = evaluate.metrics(df, "y", "p").first()
    a, b = np.array(y), np.array(p)
    assert row.rows == 4
    assert row.MAE == pytest.approx(np.abs(a - b).mean())
    assert row.RMSE == pytest.approx(np.sqrt(((a - b) ** 2).mean()))
    assert row.R_square == pytest.approx(1 - ((a - b) ** 2).sum() / ((a - a.mean()) ** 2).sum())
    assert row.MAPE_percent == pytest.approx((10 / 100 + 5 / 50 + 20 / 80) / 3 * 100)


def test_constant_target_has_no_r_square(spark):
    df = spark.createDataFrame([(5.0, 4.0), (5.0, 6.0)], "y double, p double")
    assert evaluate.metrics(df, "y", "p").first().R_square is None


def test_errors_have_no_percentage_on_zero_days(spark):
    df = spark.createDataFrame([(0.0, 5.0), (10.0, 8.0)], "actual_sales double, predicted_sales_m double")
    rows = evaluate.add_errors(df, "m").collect()
    assert [r.percentage_error_m for r in rows] == [None, 20.0]
    assert [r.error_m for r in rows] == [-5.0, 2.0]


def test_comparison_and_best(spark):
    df = spark.createDataFrame([(10.0, 9.0, 5.0), (20.0, 22.0, 20.0)], "y double, a double, b double")
    compared = evaluate.compare_models(df, "y", {"A": "a", "B": "b"})
    assert {r.Model: r.MAPE_percent for r in compared.collect()} == {"A": 10.0, "B": 25.0}
    top = evaluate.best(compared).first()
    assert (top.Model, top.target_met) == ("A", "YES")
    assert evaluate.best(compared, "MAE").first().Model == "A"


def test_matrix_fills_missing_features(spark):
    df = spark.createDataFrame([(1, None, 2)], "Store int, f double, g int").withColumn("Date", F.lit("d"))
    row = evaluate.model_matrix(df.withColumn("Sales", F.lit(3)), ["f", "g"]).first()
    assert (row.Sales, row.f, row.g) == (3.0, 0.0, 2.0)


def test_run_log_appends(spark):
    run = evaluate.log_run(spark, "lr", {"a": 1}, {"mae": 2.0}, datetime(2024, 1, 1))
    tables.write_table(run, "t_runs", mode="append")
    log = tables.write_table(run, "t_runs", mode="append")
    assert log.count() == 2 and log.first().metrics == {"mae": 2.0}
    assert log.first().params == {"a": "1"}


def test_samples_repeat_whatever_the_partitioning(spark):
    df = spark.range(20000).select(F.col("id").alias("Store"), F.lit("d").alias("Date"))
    a = {r.Store for r in analysis.sample_rows(df, ["Store", "Date"], 0.01).collect()}
    b = {r.Store for r in analysis.sample_rows(df.repartition(7), ["Store", "Date"], 0.01).collect()}
    assert a == b and 120 < len(a) < 280
    assert analysis.sample_rows(df, ["Store"], 1.0).count() == 20000


def test_correlations(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (2.0, 4.0, 1.0), (3.0, 6.0, 2.0)], "y double, a double, b double")
    top = analysis.top_correlations(df, "y", ["a", "b"], 1).first()
    assert (top.feature, round(top.correlation_with_y, 9)) == ("a", 1.0)
    matrix = {(r.feature_a, r.feature_b): r.correlation for r in analysis.correlation_matrix(df, ["y", "a", "b"]).collect()}
    assert len(matrix) == 9 and matrix["a", "b"] == matrix["b", "a"] == pytest.approx(-0.5)


def test_histogram_matches_numpy(spark):
    values = [float((i * 37) % 101) for i in range(500)] + [1e3]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    rows = analysis.histogram(df, "v", 20).orderBy("bin").collect()
    counts, edges = np.histogram(values, 20)
    assert [r.row_count for r in rows] == counts.tolist()
    assert [r.lower_edge for r in rows] == pytest.approx(edges[:-1].tolist())
    same = analysis.histogram(spark.createDataFrame([(4.0,), (4.0,)], "v double"), "v", 3)
    assert sum(r.row_count for r in same.collect()) == 2


def test_kept_results_are_made_anew_after_a_release(spark):
    before = tables.steps(spark)
    rows = spark_queries.gold_table(spark, SF).count()
    assert tables.release(spark, keep=before) > 0
    assert spark_queries.gold_table(spark, SF).count() == rows
