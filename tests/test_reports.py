from datetime import date, datetime

import pytest

from larder.operators import inventory
from larder.plans import reports

PREDICTIONS = (
    "Store int, Date date, actual_sales double, predicted_sales_boosted double, "
    "error_boosted double, percentage_error_boosted double"
)


@pytest.fixture(scope="module")
def predictions(spark):
    rows = [
        (1, date(2024, 1, 1), 100.0, 90.0, 10.0, 10.0),
        (1, date(2024, 1, 7), 200.0, 220.0, -20.0, 10.0),
        (2, date(2024, 1, 8), 0.0, 5.0, -5.0, None),
        (2, date(2024, 1, 9), 50.0, 25.0, 25.0, 50.0),
    ]
    return spark.createDataFrame(rows, PREDICTIONS)


@pytest.fixture(scope="module")
def stores(spark):
    rows = [(1, "A", "B", 999.0), (2, "A", "B", 999999.0)]
    return spark.createDataFrame(rows, "Store int, StoreType string, Assortment string, CompetitionDistance double")


def test_kpis(predictions):
    row = reports.kpi_summary(predictions).first()
    assert (row.total_stores, row.total_actual_sales, row.total_absolute_error) == (2, 350.0, 60.0)
    assert row.avg_forecast_accuracy_pct == pytest.approx(70 / 3)
    cards = {r.metric: r.value for r in reports.kpi_cards(reports.kpi_summary(predictions)).collect()}
    assert cards == {
        "Total Stores": "2", "Forecast Accuracy": "76.67%", "Total Sales (Test Period)": "$350.00",
    }


def test_accuracy_reports_equal_row_level_means(predictions, stores):
    row = reports.accuracy_by_type(predictions, stores).first()
    assert row.store_count == 2 and row.avg_mape == pytest.approx(70 / 3)
    assert row.avg_actual_sales == 87.5 and row.total_predicted_sales == 340.0
    top = reports.top_accurate(predictions, n=1).first()
    assert (top.Store, top.prediction_count, top.accuracy_score) == (1, 2, 90.0)


def test_repeated_store_rows_count_as_in_a_plain_join(predictions, stores):
    twice = reports.accuracy_by_type(predictions, stores.union(stores)).first()
    assert twice.store_count == 2 and twice.total_actual_sales == 700.0
    assert twice.avg_mape == pytest.approx(70 / 3)


def test_weeks_start_on_monday(predictions):
    weeks = {r.week_start: r.prediction_count for r in reports.weekly_trend(predictions).collect()}
    assert weeks == {date(2024, 1, 1): 2, date(2024, 1, 8): 2}


def test_promo_groups_unknown_apart(spark, predictions):
    rows = [(1, date(2024, 1, 1), 1, 2.0), (1, date(2024, 1, 7), 0, 3.0), (2, date(2024, 1, 9), None, 4.0)]
    known = spark.createDataFrame(rows, "Store int, Date date, Promo int, sales_per_customer double")
    carried = predictions.join(known, ["Store", "Date"])
    got = sorted((r.promo_status, r.days_count, r.avg_sales_per_customer) for r in reports.promo_analysis(carried).collect())
    assert got == [("No Promotion", 1, 3.0), ("No Promotion", 1, 4.0), ("With Promotion", 1, 2.0)]


def test_competition_bands(predictions, stores):
    got = {r.competition_proximity: r.store_count for r in reports.competition_impact(predictions, stores).collect()}
    assert got == {"Very Close (<1km)": 1, "Far (>10km)": 1}


def test_stock_reports(spark):
    rows = [(1, 10.0, 100.0, 300.0, 1.26, "HIGH", "URGENT", 300.4), (2, 700.0, 100.0, 300.0, 70.0, "LOW", "EXCESS", 300.0)]
    advice = spark.createDataFrame(
        rows, "Store int, current_inventory double, reorder_point double, optimal_order_qty double, "
        "days_until_stockout double, stockout_risk string, recommended_action string, forecast_next_30d double"
    )
    alert = reports.stockout_alerts(advice).first()
    assert (alert.days_until_stockout, alert.inventory_gap, alert.forecast_next_30d) == (1.3, 90.0, 300.0)
    saved = reports.savings_by_store(advice)
    assert [(r.Store, r.monthly_savings, r.annual_savings) for r in saved.collect()] == [(2, 1000.0, 12000.0)]
    total = reports.savings_total(advice).first()
    assert (total.total_annual_savings, total.stores_with_savings) == (12000.0, 1)
    assert reports.savings_total(advice.limit(0)).first().stores_with_savings == 0


def test_importance_ranks_ties_alike(spark):
    df = spark.createDataFrame([("a", 0.2), ("b", 0.5), ("c", 0.2)], "feature string, importance double")
    assert [(r.feature, r.importance_rank) for r in reports.importance_rank(df).collect()] == [
        ("b", 1), ("a", 2), ("c", 2),
    ]


def test_latest_impact(spark):
    names = [
        "forecasted_demand_30d", "inventory_reduction_units", "inventory_reduction_pct",
        "monthly_holding_cost_savings", "annual_holding_cost_savings", "stockouts_prevented",
        "stockout_cost_savings", "total_annual_roi",
    ]
    schema = "analysis_date timestamp, total_stores long, high_risk_stores long, " + ", ".join(f"{n} double" for n in names)
    rows = [
        (datetime(2024, 1, 1), 1, 1, *[1.0] * 8),
        (datetime(2024, 2, 1), 2, 1, 10.4, 5.5, 33.33, 1234.5, 14814.0, 2.0, 100.0, 14914.0),
    ]
    row = reports.impact_latest(spark.createDataFrame(rows, schema)).first()
    assert row.total_stores == 2 and row.monthly_savings == "$1,234.50"
    assert row.inventory_reduced_pct == 33.3 and row.total_annual_roi == "$14,914.00"
