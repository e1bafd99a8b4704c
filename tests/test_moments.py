import math
import random

import numpy as np
import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from larder.operators import analysis, moments


def by_pair(df):
    return {(r.a, r.b): r for r in df.collect()}


def table(spark, n=3000, gaps=True):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        x = rng.gauss(1e9, 3.0)
        row = [x, 2 * x + rng.gauss(0, 1), rng.random(), 5.0]
        rows.append([None if gaps and rng.random() < 0.2 else v for v in row])
    return spark.createDataFrame(rows, "p double, q double, r double, s double").repartition(5)


def test_moments_of_pairs_with_gaps(spark):
    df = table(spark)
    data = df.toPandas()
    found = by_pair(moments.co_moments(df, df.columns))
    assert len(found) == 10
    for (a, b), m in found.items():
        pair = data[[df.columns[a], df.columns[b]]].dropna().to_numpy() if a != b else (
            data[[df.columns[a]] * 2].dropna().to_numpy())
        x, y = pair[:, 0], pair[:, 1]
        assert m.n == len(x)
        assert (m.mean_a, m.mean_b) == pytest.approx((x.mean(), y.mean()), rel=1e-12)
        expected = [((x - x.mean()) ** 2).sum(), ((y - y.mean()) ** 2).sum(),
                    ((x - x.mean()) * (y - y.mean())).sum()]
        assert [m.moment_a, m.moment_b, m.moment_ab] == pytest.approx(expected, rel=1e-6, abs=1e-6)


def test_merged_parts_equal_the_whole(spark):
    df = table(spark, gaps=False)
    parts = [moments.co_moments(df.filter(F.col("r") < 0.3), df.columns),
             moments.co_moments(df.filter(F.col("r") >= 0.3), df.columns),
             moments.co_moments(df.limit(0), df.columns)]
    merged = by_pair(moments.merge(parts[0].unionAll(parts[1]).unionAll(parts[2])))
    whole = by_pair(moments.co_moments(df, df.columns))
    for pair, m in whole.items():
        assert list(merged[pair])[2:] == pytest.approx(list(m)[2:], rel=1e-5, abs=1e-3)


def test_correlations_skip_nulls_and_show_nan(spark):
    rows = [(1.0, 2.0, None, float("nan"), 7.0), (2.0, 4.5, 1.0, 1.0, 7.0), (3.0, None, 2.0, 2.0, 7.0),
            (4.0, 8.0, None, 3.0, 7.0), (None, 1.0, None, 4.0, 7.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double")
    found = {(r.feature_a, r.feature_b): r.correlation
             for r in analysis.correlation_matrix(df, df.columns).collect()}
    assert len(found) == 25 and all(found[x, y] == found[y, x] or math.isnan(found[x, y]) for x, y in found)
    assert found["a", "b"] == pytest.approx(np.corrcoef([1, 2, 4], [2, 4.5, 8])[0, 1])
    assert found["a", "a"] == 1 and found["a", "c"] == pytest.approx(1)
    assert found["b", "c"] is None and found["e", "e"] is None and found["a", "e"] is None
    assert math.isnan(found["a", "d"]) and found["c", "d"] == pytest.approx(1)


def test_one_scan_and_no_row_per_pair(spark):
    df = spark.range(100).selectExpr("id * 1.0 AS x", "id % 7 AS y", "id % 3 AS z")
    plan = plan_of(analysis.correlation_matrix(df, df.columns))
    assert "Generate" not in plan and plan.count("Range (0, 100") == 1 and "MapInArrow" in plan


def test_linear_recovers_coefficients_and_leaves_dead_inputs_alone(spark):
    df = spark.range(500).selectExpr("id % 13 AS u", "id % 7 AS v", "1 AS w", "3 * (id % 13) - (id % 7) + 2 AS y")
    found, intercept = moments.linear(spark, moments.co_moments(df, df.columns), ["u", "v", "w"])
    assert {r.feature: r.coefficient for r in found.collect()} == pytest.approx({"u": 3, "v": -1, "w": 0}, abs=1e-9)
    assert intercept == pytest.approx(2)


def test_linear_refuses_pairs_of_different_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 3.0)], "x double, y double")
    with pytest.raises(ValueError):
        moments.linear(spark, moments.co_moments(df, df.columns), ["x"])
