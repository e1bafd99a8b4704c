from datetime import date, datetime

from conftest import SF
from helpers import raw_rows
from pyspark.sql import functions as F

from larder.operators import cleaning
from larder.sources import panel

AT = datetime(2024, 1, 1)


def test_bad_dates_become_null_and_are_dropped(spark):
    df = raw_rows(spark, {"Date": "2013-13-01"}, {"Date": "no date"}, {"Date": "2013-02-01"})
    assert [r.Date for r in cleaning.standardize_date(df).collect()] == [None, None, date(2013, 2, 1)]
    assert cleaning.clean_sales(df, AT).count() == 1


def test_dates_of_other_types(spark):
    df = raw_rows(spark, {"Date": "2013-02-01"})
    for kind in ("timestamp", "timestamp_ntz", "date"):
        typed = df.withColumn("Date", F.col("Date").cast(kind))
        assert cleaning.standardize_date(typed).first().Date == date(2013, 2, 1)


def test_three_valued_logic_of_the_closed_rule(spark):
    df = raw_rows(
        spark, {"Open": None, "Sales": 10.0}, {"Open": None, "Sales": 0.0, "Store": 2},
        {"Open": 0, "Sales": 5.0, "Store": 3}, {"Store": 4},
    )
    assert sorted(r.Store for r in cleaning.drop_closed_sales(df).collect()) == [2, 4]


def test_negative_rule_drops_nulls_too(spark):
    df = raw_rows(spark, {"Sales": None}, {"Sales": -1.0}, {"Sales": 0.0})
    assert [r.Sales for r in cleaning.drop_negative_sales(df).collect()] == [0.0]


def test_unconvertible_numbers_become_null(spark):
    df = raw_rows(spark, {}).withColumn("Promo", F.lit("yes")).withColumn("Sales", F.lit("1.5"))
    row = cleaning.standardize_types(df).first()
    assert row.Promo is None and row.Sales == 1.5


def test_holiday_codes(spark):
    df = raw_rows(
        spark,
        *[{"Store": i, "StateHoliday": h} for i, h in enumerate("0abcx")],
        {"Store": 5, "StateHoliday": None, "SchoolHoliday": 1},
        {"Store": 6, "StateHoliday": None},
    )
    rows = cleaning.business_flags(cleaning.decode(df, "StateHoliday")).orderBy("Store").collect()
    assert [r.StateHoliday for r in rows] == ["None", "Public", "Easter", "Christmas", "x", None, None]
    assert [r.is_holiday for r in rows] == [0, 1, 1, 1, 1, 1, 0]


def test_dedupe_of_differing_copies_does_not_depend_on_input_order(spark):
    changes = [{"Sales": 3.0}, {"Sales": 1.0}, {"Sales": 2.0}, {"Sales": 2.0}]
    for rows in (changes, changes[::-1]):
        kept = cleaning.dedupe(raw_rows(spark, *rows)).collect()
        assert [r.Sales for r in kept] == [1.0]
    newest = cleaning.dedupe(raw_rows(spark, *changes), order=[F.desc("Sales")]).collect()
    assert [r.Sales for r in newest] == [3.0]


def test_dedupe_keeps_the_newest_load_then_the_fullest_row(spark):
    rows = [
        (1, "d", 100.0, 5, "2024-01-01", "a"), (1, "d", 250.0, None, "2024-01-02", "b"),
        (1, "d", 250.0, 6, "2024-01-02", "c"), (2, "d", None, 1, None, "d"), (2, "d", 9.0, 1, None, "e"),
    ]
    df = spark.createDataFrame(
        rows, "Store int, Date string, Sales double, Customers int, ingestion_timestamp string, row_hash string"
    )
    kept = {r.Store: (r.Sales, r.Customers) for r in cleaning.dedupe(df).collect()}
    assert kept == {1: (250.0, 6), 2: (9.0, 1)}


def test_a_store_loaded_twice_stays_one_row(spark):
    stores = panel.raw_stores(spark, SF).withColumn("ingestion_timestamp", F.lit("2024-01-01"))
    newer = stores.withColumns({"Promo2": F.lit(1), "ingestion_timestamp": F.lit("2024-01-02")})
    kept = cleaning.clean_stores(stores.unionByName(newer))
    assert kept.count() == stores.count() and kept.filter("Promo2 <> 1").isEmpty()


def test_cleaning_is_idempotent_and_leaves_unique_keys(spark):
    df = raw_rows(spark, {}, {}, {"Store": 2}, {"Store": 3, "Open": 0, "Sales": 0.0})
    once = cleaning.apply_sales_rules(df)
    twice = cleaning.apply_sales_rules(once)
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
    assert once.groupBy("Store", "Date").count().filter("count > 1").isEmpty()


def test_audit_adds_up(spark):
    df = raw_rows(
        spark, {}, {}, {"Store": 2, "Open": 0}, {"Store": 3, "Sales": -1.0},
        {"Store": 4, "Sales": None}, {"Store": 5, "DayOfWeek": None}, {"Store": None},
    )
    steps = cleaning.audit_rules(df).orderBy("step").collect()
    # NULL sales at an open store fail the closed-store rule for no one: Open = 0 is false there.
    assert [(r.rule, r.rows_removed) for r in steps] == [
        ("closed_with_sales", 1), ("negative_sales", 2), ("null_critical", 2), ("duplicate_key", 1),
    ]
    assert steps[0].rows_before == 7
    assert all(a.rows_after == b.rows_before for a, b in zip(steps, steps[1:]))
    assert steps[-1].rows_after == cleaning.apply_sales_rules(df).count()


def test_audit_of_nothing(spark):
    steps = cleaning.audit_rules(raw_rows(spark, {}).limit(0)).collect()
    assert len(steps) == 4 and steps[0].retention_pct is None


def test_stores(spark):
    schema = (
        "Store int, StoreType string, Assortment string, CompetitionDistance double, "
        "CompetitionOpenSinceMonth int, CompetitionOpenSinceYear int, Promo2 int, "
        "Promo2SinceWeek int, Promo2SinceYear int, PromoInterval string"
    )
    rows = [
        (1, " a ", "c", None, None, None, None, None, None, None),
        (2, "B", "a", 999.0, 1, 2000, 1, 3, 2010, "Jan"),
        (3, "b", "a", 1000.0, 1, 2000, 0, 3, 2010, "Jan"),
        (4, "b", "a", 5000.0, 1, 2000, 0, 3, 2010, "Jan"),
        (5, "b", "a", 10000.0, 1, 2000, 0, 3, 2010, "Jan"),
        (None, "b", "a", 1.0, 1, 2000, 0, 3, 2010, "Jan"),
    ]
    cleaned = cleaning.clean_stores(spark.createDataFrame(rows, schema), AT)
    got = {r.Store: r for r in cleaned.collect()}
    assert set(got) == {1, 2, 3, 4, 5}
    assert got[1].StoreType == "A" and got[1].store_category == "A-C"
    assert got[1].CompetitionDistance == 999999 and got[1].has_competition == 0
    assert got[1].competition_distance_km is None and got[1].PromoInterval == "None"
    assert got[1].Promo2 == 0 and got[1].in_promo2 == 0 and got[2].in_promo2 == 1
    assert [got[i].competition_proximity for i in range(1, 6)] == [
        "None", "Very Close", "Close", "Moderate", "Far",
    ]
    assert got[2].competition_distance_km == 0.999
