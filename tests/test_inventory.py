import math
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from larder.operators import inventory
from larder.params import InventoryPolicy

Z = 1.6448536269514722
LATEST = "Store int, latest_date date, forecast_next_30d double, demand_volatility_30d double, current_inventory double"
DAY = date(2024, 1, 1)


def plan(spark, *rows):
    df = spark.createDataFrame([(i, DAY, *r) for i, r in enumerate(rows)], LATEST)
    return inventory.optimize(df.drop("current_inventory"), df.select("Store", "current_inventory"))


def test_levels_follow_the_formulas(spark):
    row = plan(spark, (300.0, 0.5, 50.0)).first()
    assert row.avg_daily_demand == 10 and row.demand_std == 5 and row.optimal_order_qty == 300
    assert row.safety_stock == pytest.approx(Z * 5 * math.sqrt(7))
    assert row.reorder_point == pytest.approx(70 + Z * 5 * math.sqrt(7))
    assert row.economic_order_qty == pytest.approx(math.sqrt(2 * 3600 * 100 / 30))
    assert row.stockout_risk == "HIGH" and row.days_until_stockout == 5
    assert row.service_level == 95


def test_edges(spark):
    zero, unknown, nan, none = plan(
        spark, (0.0, 0.5, 10.0), (300.0, 0.5, None), (300.0, float("nan"), 500.0), (300.0, None, 500.0)
    ).orderBy("Store").collect()
    assert zero.days_until_stockout == 999 and zero.economic_order_qty == 0 and zero.safety_stock == 0
    assert unknown.stockout_risk == "UNKNOWN" and unknown.days_until_stockout is None
    assert nan.safety_stock == 0 and nan.reorder_point == 70
    assert none.safety_stock is None and none.stockout_risk == "UNKNOWN"


def test_unknown_is_not_healthy(spark):
    advice = inventory.graded_priority(
        inventory.recommend(plan(spark, (None, None, 5.0), (300.0, 0.5, None), (300.0, 0.5, 500.0)))
    )
    lost, unstocked, known = advice.orderBy("Store").collect()
    for row in (lost, unstocked):
        assert row.stockout_risk == "UNKNOWN" and row.recommended_action.startswith("UNKNOWN")
        assert row.days_until_stockout is None
        assert row.order_priority is None and row.graded_priority is None and row.excess_inventory is None
    assert lost.safety_stock is None and lost.reorder_point is None and lost.economic_order_qty is None
    assert known.order_priority == 4
    totals = inventory.impact_totals(advice).first()
    assert (totals.total_stores, totals.unknown_stores) == (3, 2)


def test_reorder_point_never_lies_under_safety_stock(spark):
    df = spark.range(200).select(
        (F.col("id") * 13 % 97).cast("double").alias("d"), (F.col("id") * 7 % 31 - 3.0).alias("s")
    )
    safety = inventory.safety_stock(F.col("s"), F.lit(Z), 7)
    point = inventory.reorder_point(F.col("d"), safety, 7)
    assert df.filter((point < safety) | (safety < 0)).isEmpty()


def test_actions_and_priorities(spark):
    advice = inventory.graded_priority(inventory.recommend(plan(
        spark, (300.0, 0.5, 50.0), (300.0, 0.5, 75.0), (300.0, 0.5, 100.0), (300.0, 0.5, 601.0),
        (300.0, 9.0, 80.0),
    ))).orderBy("Store").collect()
    assert [r.recommended_action.split(":")[0] for r in advice] == [
        "URGENT", "URGENT", "NORMAL", "EXCESS", "URGENT",
    ]
    assert [r.order_priority for r in advice] == [1, 1, 4, 4, 1]
    assert [r.graded_priority for r in advice] == [1, 3, 4, 4, 2]
    assert [r.excess_inventory for r in advice] == [0, 0, 0, 301, 0]
    assert advice[0].inventory_gap == pytest.approx(advice[0].reorder_point - 50)


def forecasts(spark, days, store=1):
    return spark.createDataFrame(
        [(store, DAY + timedelta(days=i), 10.0, 1.0, 0.5) for i in range(days)],
        "Store int, Date date, actual_sales double, predicted_sales_boosted double, demand_volatility double",
    )


def test_horizon_of_one_row_and_of_thirty(spark):
    ahead = inventory.roll_forward(forecasts(spark, 40))
    one = inventory.latest_forecast(ahead, 1).first()
    full = inventory.latest_forecast(ahead, 30).first()
    assert (one.latest_date, one.forecast_next_30d) == (DAY + timedelta(days=39), 1.0)
    assert (full.latest_date, full.forecast_next_30d) == (DAY + timedelta(days=10), 30.0)
    assert full.avg_actual_sales == 10.0


def test_store_without_a_full_frame_keeps_its_row(spark):
    both = forecasts(spark, 40).unionByName(forecasts(spark, 5, store=2))
    latest = inventory.latest_forecast(inventory.roll_forward(both), 30)
    assert {r.Store: r.forecast_next_30d for r in latest.collect()} == {1: 30.0, 2: None}


def test_enrich_keeps_predictions_without_features(spark):
    predictions = forecasts(spark, 2).drop("demand_volatility")
    known = spark.createDataFrame([(1, DAY, 0.25, 2.0)], "Store int, Date date, demand_volatility double, rolling_std_30 double")
    rows = inventory.enrich(predictions, known).orderBy("Date").collect()
    assert [r.demand_volatility for r in rows] == [0.25, None]


def test_impact_and_urgent(spark):
    advice = inventory.recommend(plan(spark, (300.0, 0.5, 50.0), (300.0, 0.5, 750.0)))
    impact = inventory.business_impact(advice, InventoryPolicy()).first()
    assert (impact.total_stores, impact.high_risk_stores) == (2, 1)
    assert impact.inventory_reduction_units == 200 and impact.inventory_reduction_pct == 25
    assert impact.annual_holding_cost_savings == 200 * 2.5 * 12
    assert impact.stockouts_prevented == pytest.approx(0.1 * 600)
    assert impact.total_annual_roi == pytest.approx(6000 + 60 * 50)
    assert [r.Store for r in inventory.urgent(advice).collect()] == [0]
    nothing = inventory.business_impact(advice.limit(0)).first()
    assert nothing.total_stores == 0 and nothing.inventory_reduction_pct is None


def test_stand_in_stock_lies_within_sixty_days(spark):
    df = spark.range(500).select(F.col("id").cast("int").alias("Store"), F.lit(30.0).alias("forecast_next_30d"))
    row = inventory.attach_inventory(df).agg(F.min("current_inventory"), F.max("current_inventory")).first()
    assert row[:] == (0.0, 60.0)
