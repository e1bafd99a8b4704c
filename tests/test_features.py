import math
from datetime import date

import pytest
from conftest import SF, plan_of
from helpers import series
from pyspark.sql import functions as F

from larder import params as P
from larder.operators import cleaning, features
from larder.sources import panel


def column(df, name):
    return [r[name] for r in df.orderBy("Store", "Date").collect()]


def gold(spark):
    return features.build_features(
        cleaning.apply_sales_rules(panel.raw_sales(spark, SF)),
        cleaning.clean_stores(panel.raw_stores(spark, SF)),
    )


def test_lag_counts_rows_and_calendar_lag_counts_days(spark):
    df = series(spark, [1.0, 2.0, 3.0, 4.0], gaps=[1])
    assert column(features.add_lags(df, "Sales", [1]), "sales_lag_1") == [None, 1.0, 3.0]
    by_day = features.add_lags(df, "Sales", [1, 2], calendar=True)
    assert column(by_day, "sales_lag_1") == [None, None, 3.0]
    assert column(by_day, "sales_lag_2") == [None, 1.0, None]


def test_lag_equals_a_join_on_row_numbers(spark):
    df = panel.store_days(spark, SF).withColumn(
        "n", F.row_number().over(features.by_store())
    )
    lagged = features.add_lags(df, "Sales", [7])
    earlier = df.select("Store", (F.col("n") + 7).alias("n"), F.col("Sales").alias("by_join"))
    both = lagged.join(earlier, ["Store", "n"], "left")
    assert both.filter(~F.col("sales_lag_7").eqNullSafe(F.col("by_join"))).isEmpty()


def test_rolling_leaves_the_current_row_out(spark):
    df = series(spark, [1.0, 3.0, 5.0, 100.0])
    rolled = features.add_rolling(df, "Sales", "mean", [2])
    assert column(rolled, "rolling_mean_2") == [None, 1.0, 2.0, 4.0]
    assert column(features.add_rolling(df, "Sales", "median", [2]), "rolling_median_2") == [
        None, 1.0, 1.0, 3.0,
    ]
    assert column(features.add_rolling(df, "Sales", "std", [3]), "rolling_std_3")[:2] == [None, None]


@pytest.mark.parametrize("hole", [None, 5])
def test_merged_moments_equal_direct_frames(spark, hole):
    values = [float((i * 7919) % 1009) for i in range(250)]
    if hole:
        values = [None if i % hole == 0 else v for i, v in enumerate(values)]
    df = series(spark, values)
    direct = features.add_rolling(
        features.add_rolling(df, "Sales", "mean", P.MEAN_WINDOWS), "Sales", "std", P.STD_WINDOWS
    )
    merged = features.add_rolling_moments(df, "Sales", P.MEAN_WINDOWS, P.STD_WINDOWS)
    names = [f"rolling_mean_{k}" for k in P.MEAN_WINDOWS]
    names += [f"rolling_std_{k}" for k in P.STD_WINDOWS]
    assert merged.columns == [*df.columns, *names]
    for name in names:
        for a, b in zip(column(direct, name), column(merged, name)):
            assert (a is None) == (b is None)
            assert a is None or b == pytest.approx(a, rel=1e-12, abs=1e-9)


def test_merged_deviation_of_a_constant_is_zero(spark):
    merged = features.add_rolling_moments(series(spark, [7000.5] * 120), "Sales", [7], [30, 90])
    assert set(column(merged, "rolling_std_90")[2:]) == {0.0}


def test_growth_and_ratios_are_guarded(spark):
    df = series(spark, [0.0, 10.0, 15.0]).withColumn("Customers", F.lit(0))
    grown = features.add_growth(features.add_lags(df, "Sales", [1]), "Sales", [1])
    assert column(grown, "sales_growth_1d") == [0.0, 0.0, 50.0]
    assert column(features.add_sales_per_customer(df), "sales_per_customer") == [0.0, 0.0, 0.0]


def test_momentum_and_volatility_defaults(spark):
    rows = [
        (1, date(2020, 1, 1), None, None, None), (1, date(2020, 1, 2), 12.0, 10.0, 5.0),
        (1, date(2020, 1, 3), 8.0, 10.0, None), (1, date(2020, 1, 4), 10.0, 0.0, 1.0),
    ]
    df = spark.createDataFrame(
        rows, "Store int, Date date, rolling_mean_7 double, rolling_mean_30 double, rolling_std_30 double"
    )
    df = features.add_momentum(features.add_volatility(df))
    assert column(df, "sales_momentum") == [1.0, 1.2, 0.8, 1.0]
    assert column(df, "trend_direction") == ["Stable", "Increasing", "Decreasing", "Stable"]
    assert column(df, "demand_volatility") == [0.0, 0.5, None, 0.0]


def test_calendar_and_cycles(spark):
    rows = [(1, date(2024, 2, 29)), (1, date(2023, 1, 1)), (1, date(2022, 12, 31))]
    df = features.add_cyclic(features.add_calendar(spark.createDataFrame(rows, "Store int, Date date")))
    got = {r.Date: r for r in df.collect()}
    leap, sunday, eve = (got[r[1]] for r in rows)
    assert leap.days_in_month == 29 and leap.season == "Winter" and leap.season_num == 4
    assert sunday.day_of_week == 1 and sunday.is_weekend == 1 and sunday.week_of_year == 52
    assert sunday.is_month_start == 1 and eve.is_month_end == 1 and eve.quarter == 4
    assert eve.day_sin == pytest.approx(0, abs=1e-9)
    assert leap.month_cos == pytest.approx(math.cos(2 * math.pi * 2 / 12))


def test_promo_labels(spark):
    rows = [(1, 5.0, 4.0), (1, 4.0, 4.0), (1, 4.0, None), (0, 9.0, 1.0)]
    df = spark.createDataFrame(rows, "Promo int, Sales double, rolling_mean_30 double")
    labels = [r.promo_effectiveness for r in features.add_promo_effect(df).collect()]
    assert labels == ["Effective", "Ineffective", "No Promo", "No Promo"]


def test_scores_pressure_and_tier(spark):
    rows = [("A", "A", 499.0, 8000.5), ("B", "D", 999.0, 8000.0), ("?", "?", 999999.0, 5000.0), (None, None, None, None)]
    df = spark.createDataFrame(
        rows, "Assortment string, StoreType string, CompetitionDistance double, avg_sales_per_store double"
    )
    df = features.add_tier(features.add_store_scores(features.add_competition_pressure(df)))
    got = df.collect()
    assert [r.assortment_score for r in got] == [1, 2, 1, 1]
    assert [r.store_type_score for r in got] == [1, 4, 1, 1]
    assert [r.competition_pressure for r in got] == [5, 4, 0, 0]
    assert [r.store_performance_tier for r in got] == ["High", "Medium", "Low", "Low"]


def test_join_prefixes_clashing_columns_and_keeps_every_fact(spark):
    fact = spark.createDataFrame([(1, "f"), (2, "f")], "Store int, layer string")
    dim = spark.createDataFrame([(1, "d", 5)], "Store int, layer string, size int")
    joined = features.join_dim(fact, dim)
    assert joined.columns == ["Store", "layer", "store_layer", "size"]
    assert {r.Store: r.store_layer for r in joined.collect()} == {1: "d", 2: None}


def test_gold_holds_every_registered_feature_and_no_warmup_rows(spark):
    built = gold(spark)
    registered = {f for names in P.FEATURE_CATEGORIES.values() for f in names}
    assert registered <= set(built.columns)
    assert built.first().total_features == len(registered)
    assert built.filter("sales_lag_30 IS NULL").isEmpty()
    assert built.groupBy("Store", "Date").count().filter("count > 1").isEmpty()


def test_features_do_not_see_later_rows(spark):
    sales = cleaning.apply_sales_rules(panel.raw_sales(spark, SF))
    stores = cleaning.clean_stores(panel.raw_stores(spark, SF))
    cut = date(1998, 1, 1)
    skip = ["avg_sales_per_store", "store_performance_tier"]
    drop = [*skip, "feature_engineering_timestamp", "processing_timestamp", "store_processing_timestamp"]
    whole = features.build_features(sales, stores).filter(F.col("Date") < cut).drop(*drop)
    early = features.build_features(sales.filter(F.col("Date") < cut), stores).drop(*drop)
    assert early.count() > 0
    assert whole.exceptAll(early).isEmpty() and early.exceptAll(whole).isEmpty()


def test_dictionary(spark):
    names = [f for group in P.FEATURE_CATEGORIES.values() for f in group]
    known = spark.range(3).select(*[F.when(F.col("id") > 0, 1).alias(f) for f in names])
    dictionary = features.feature_coverage(known)
    assert {r.filled_rows for r in dictionary.collect()} == {2}
    counts = {r.category: r.features for r in features.feature_counts(dictionary).collect()}
    assert counts == {c: len(names) for c, names in P.FEATURE_CATEGORIES.items()}
    kinds = {r.feature_name: r.data_type for r in dictionary.collect()}
    assert kinds["season"] == "Categorical" and kinds["season_num"] == "Numeric"
    assert len(P.REFERENCE_FEATURES) == 33 and len(P.SAFE_FEATURES) == 30


def test_order_statistics_of_frames_come_from_one_sort(spark):
    """As by the aggregates, with gaps, ties and short frames; and without a sketch per row."""
    value = F.when(F.col("id") % 7 != 3, ((F.col("id") * 37) % 11 - 5) / 8.0)
    df = spark.range(300).select(
        (F.col("id") % 4).cast("int").alias("Store"),
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") * 2).cast("int")).alias("Date"),
        value.alias("Sales"),
        F.lit(3).alias("Customers"),
        F.lit(1).alias("Promo"),
    )
    for calendar in (False, True):
        found = features.add_rolling_features(df, calendar)
        window = features.preceding(30, calendar)
        wanted = {
            "min": F.min("Sales").over(window),
            "max": F.max("Sales").over(window),
            "median": F.percentile_approx("Sales", 0.5).over(window),
        }
        both = found.withColumns({f"wanted_{k}": c for k, c in wanted.items()})
        for stat in wanted:
            assert both.filter(~F.col(f"rolling_{stat}_30").eqNullSafe(F.col(f"wanted_{stat}"))).isEmpty()
        assert "percentile_approx" not in plan_of(found)
