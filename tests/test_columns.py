from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from larder.functions import columns as C


def test_row_hash_skips_nulls_unless_told_otherwise(spark):
    df = spark.createDataFrame([("a", None), (None, "a")], "x string, y string")
    plain = {r.h for r in df.select(C.row_hash(["x", "y"]).alias("h")).collect()}
    marked = {r.h for r in df.select(C.row_hash(["x", "y"], "~").alias("h")).collect()}
    assert len(plain) == 1
    assert len(marked) == 2


def test_edges_and_lookups(spark):
    df = spark.createDataFrame([(1.0, "a"), (5.0, "b"), (9.0, None), (None, "z")], "v double, c string")
    below = C.first_below(F.col("v"), [(2, "low"), (6, "mid")], "none")
    above = C.first_above(F.col("v"), [(6, "high"), (2, "mid")], "none")
    code = C.lookup(F.col("c"), {"a": 1, "b": 2}, 0)
    rows = df.select(below.alias("b"), above.alias("a"), code.alias("k")).collect()
    assert [r.b for r in rows] == ["low", "mid", "none", "none"]
    assert [r.a for r in rows] == ["none", "mid", "high", "none"]
    assert [r.k for r in rows] == [1, 2, 0, 0]


def test_guarded_ratio_never_divides_by_zero(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, None), (None, 2.0), (1.0, 4.0)], "n double, d double")
    rows = df.select(C.guarded_ratio(F.col("n"), F.col("d"), 7.0).alias("r")).collect()
    assert [r.r for r in rows] == [7.0, 7.0, None, 0.25]


def test_normal_quantile_of_a_column(spark):
    levels = [1e-12, 0.001, 0.05, 0.3, 0.5, 0.7, 0.95, 0.999]
    df = spark.createDataFrame([(p,) for p in levels], "p double")
    for row in df.select("p", C.normal_quantile(F.col("p")).alias("z")).collect():
        assert row.z == pytest.approx(NormalDist().inv_cdf(row.p), abs=1e-8)
    edges = spark.createDataFrame([(0.0,), (1.0,), (None,)], "p double")
    assert [r[0] for r in edges.select(C.normal_quantile(F.col("p"))).collect()] == [None] * 3


def test_normal_quantile_of_a_level(spark):
    z = spark.range(1).select(C.normal_quantile(0.95).alias("z")).first().z
    assert z == pytest.approx(1.6448536, abs=1e-7)


def test_round_half_up_equals_round(spark):
    near = [k / 8 for k in range(-40, 41)] + [i + 0.00005 for i in range(-300, 300)] + [k / 1e5 + 5e-6 for k in range(300)]
    odd = [0.0, -0.0, 1e-12, -1e-12, 1.00005, 2.5e15, 1e300, 123456.78905, float("nan"), float("inf"), float("-inf"), None]
    df = spark.createDataFrame([(v,) for v in near + odd], "v double")
    for digits in (1, 2, 4, 6):
        found, wanted = C.round_half_up(F.col("v"), digits) + 0.0, F.round("v", digits) + 0.0
        assert df.filter(~found.eqNullSafe(wanted)).isEmpty()


def test_large_generated_methods_are_split(spark):
    C.keep_compiled(spark)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= C.COMPILED_BYTES
