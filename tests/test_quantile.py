import numpy as np
import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from larder.operators import quantile

N = 120000
LEVELS = [0.0, 0.0001, 0.01, 0.5, 0.9, 0.99, 0.9999, 1.0]


def spread(spark):
    """Many distinct values, far more rows than the sketch keeps."""
    v = F.sin(F.col("id") * 12.9898) * 43758.5453
    return spark.range(N).select((v * v).alias("v"))


def one_value_holds_a_third(spark):
    v = F.when(F.col("id") % 3 == 0, 777.0).otherwise(F.col("id") * 0.01)
    return spark.range(N).select(v.alias("v"))


def coarse_and_gappy(spark):
    v = F.when(F.col("id") % 7 != 0, (F.col("id") * 37 % 11).cast("double"))
    return spark.range(N).select(v.alias("v"))


@pytest.mark.parametrize("make", [spread, one_value_holds_a_third, coarse_and_gappy])
def test_large_columns_match_numpy(spark, make):
    df = make(spark)
    values = np.array([r.v for r in df.collect() if r.v is not None])
    got = [r["quantile"] for r in quantile.exact_quantile(df, "v", LEVELS).collect()]
    assert got == pytest.approx(list(np.quantile(values, LEVELS)), rel=1e-12)


def test_ranks_are_enclosed_whatever_is_proposed(spark, monkeypatch):
    """A sketch that proposes values far too high or too low costs time, never the right rank."""
    df = spark.range(100).select(F.col("id").cast("double").alias("v"))
    for near in ([80.0, 99.0], [0.0, 3.0], [50.0], []):
        proposed = sorted({0.0, 99.0, *near})
        monkeypatch.setattr(quantile, "_proposed", lambda values, qs, p=proposed: (100, p))
        assert quantile.quantile_values(df, "v", [0.5, 0.0, 1.0, 0.995]) == [49.5, 0.0, 99.0, 98.505]


@pytest.mark.parametrize("make", [spread, one_value_holds_a_third, coarse_and_gappy])
def test_bands_are_narrowed_until_they_are_bounded(spark, monkeypatch, make):
    monkeypatch.setattr(quantile, "MOST_SORTED", 8)
    monkeypatch.setattr(quantile, "ACCURACY", 40)
    sorted_rows = []
    within = quantile._Band.within
    values_at = quantile._values_at
    monkeypatch.setattr(quantile, "_values_at", lambda values, band, ranks: (
        sorted_rows.append(0 if band.low == band.high else within(band, values).count()),
        values_at(values, band, ranks))[1])
    df = make(spark).persist()
    values = np.array([r.v for r in df.collect() if r.v is not None])
    levels = [0.0, 0.013, 0.5, 0.99, 1.0]
    got = quantile.quantile_values(df, "v", levels)
    assert got == pytest.approx(list(np.quantile(values, levels)), rel=1e-12)
    # Two neighbours of which one is held by many rows stay; a value's rows are one row when sorted.
    assert len(sorted_rows) == 5 and all(n <= 8 or make is not spread for n in sorted_rows)
    df.unpersist()


def test_narrowing_ends_whatever_is_proposed(spark, monkeypatch):
    monkeypatch.setattr(quantile, "MOST_SORTED", 3)
    df = spark.range(64).select((F.col("id") * F.col("id")).cast("double").alias("v")).persist()
    monkeypatch.setattr(quantile, "_proposed", lambda values, qs: (64, [0.0, 3969.0]))
    assert quantile.quantile_values(df, "v", [0.5, 0.0, 1.0]) == [(31**2 + 32**2) / 2, 0.0, 3969.0]
    df.unpersist()


def test_reads_its_input_a_few_times(spark, tmp_path):
    spark.range(50_000).select((F.col("id") * 7919 % 50_021).cast("double").alias("v")).write.parquet(
        str(tmp_path / "v")
    )
    df = spark.read.parquet(str(tmp_path / "v"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("quantile", "one quantile")
    flagged = quantile.flag_above_quantile(df, "v", 0.99)
    jobs = tracker.getJobIdsForGroup("quantile")
    spark.sparkContext._jsc.clearJobGroup()
    assert 2 <= len(jobs) <= 8  # three reads; adaptive execution runs a job per shuffle
    assert plan_of(flagged).count("FileScan") == 1  # the bound is a number by now


def test_small_columns(spark):
    df = spark.createDataFrame([(float(i),) for i in (5, 1, 4)] + [(None,)], "v double")
    assert quantile.exact_quantile(df, "v", 0.5).first()["quantile"] == 4.0
    assert quantile.exact_quantile(df, "v", 0.75).first()["quantile"] == 4.5
    odd = df.unionByName(spark.createDataFrame([(float("nan"),), (float("inf"),)], "v double"))
    assert quantile.quantile_values(odd, "v", [0.0, 1.0]) == [1.0, float("inf")]
    single = df.filter("v = 5")
    assert quantile.exact_quantile(single, "v", 0.99).first()["quantile"] == 5.0
    assert quantile.exact_quantile(df.filter("v > 9"), "v", 0.99).first()["quantile"] is None


def test_flags_only_rows_above_the_threshold(spark):
    df = spark.range(1, 1001).select(F.col("id").cast("double").alias("v"))
    for exact in (True, False):
        flagged = quantile.flag_above_quantile(df, "v", 0.99, exact=exact)
        assert flagged.filter("is_outlier = 1").count() == 10
        assert flagged.count() == 1000
