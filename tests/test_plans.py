"""What the physical plans have to look like, and the whole job from files to views."""

import re
from datetime import datetime

import pytest
from conftest import SF, plan_of
from pyspark.sql import functions as F

from larder import params as P
from larder.operators import cleaning, evaluate, features, inventory, models, quality
from larder.plans import medallion, reports
from larder.sources import panel, tables


def hash_exchanges(plan):
    return re.findall(r"Exchange hashpartitioning\(([^)]*?), \d+\)", plan)


def test_all_features_take_one_shuffle_by_store(spark):
    sales = panel.store_days(spark, SF)
    stores = tables.materialize(cleaning.clean_stores(panel.raw_stores(spark, SF)))
    complete = sales.withColumns(
        {c: F.lit(0) for c in ("Open", "is_holiday", "is_promo_day", "SchoolHoliday")}
        | {"StateHoliday": F.lit("None")}
    )
    sales = tables.materialize(complete)
    plan = plan_of(features.build_features(sales, stores))
    assert len(hash_exchanges(plan)) == 1
    assert len(re.findall(r"\bSort \[", plan)) == 1
    assert "Python" not in plan


def test_large_store_table_joins_on_the_same_shuffle(spark):
    sales = tables.materialize(panel.store_days(spark, SF))
    stores = tables.materialize(panel.raw_stores(spark, SF))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lagged = features.add_lags(sales, "Sales", [7])
        exchanges = hash_exchanges(plan_of(features.join_dim(lagged, stores)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert len(exchanges) == 2  # the facts once, the stores once


def test_a_supplier_with_a_third_of_all_lines(spark, tmp_path):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("l_suppkey") == 1, 7).otherwise(1)))
    lines.withColumn("time", times).drop("time").write.parquet(str(tmp_path / "lineitem.parquet"))
    days = panel.store_days(spark, str(tmp_path))
    counts = {r.Store: r.n for r in days.groupBy("Store").agg(F.count("*").alias("n")).collect()}
    plain = panel.store_days(spark, SF)
    assert counts[1] == plain.filter("Store = 1").count()
    both = days.join(plain.select("Store", "Date", F.col("Sales").alias("once")), ["Store", "Date"])
    assert both.filter("Store = 1 AND Sales <> once * 7").isEmpty()
    assert both.filter("Store <> 1 AND Sales <> once").isEmpty()


def test_dedupe_cuts_copies_before_the_shuffle(spark):
    rows = spark.createDataFrame([(1, "d", 1.0)], "Store int, Date string, Sales double")
    plan = plan_of(cleaning.dedupe(rows))
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_checks_combine_before_the_shuffle(spark):
    plan = plan_of(quality.violations(panel.raw_sales(spark, SF)))
    assert "partial_count" in plan


def test_top_k_reports_do_not_sort_everything(spark):
    advice = spark.createDataFrame(
        [(1, 1.0, 1.0, 1.0, 1.0, "HIGH", "a")],
        "Store int, current_inventory double, reorder_point double, optimal_order_qty double, "
        "days_until_stockout double, stockout_risk string, recommended_action string",
    )
    assert "TakeOrderedAndProject" in plan_of(inventory.urgent(advice))


def test_filters_and_columns_reach_the_scan(spark):
    sales = tables.materialize(panel.store_days(spark, SF))
    plan = plan_of(cleaning.drop_negative_sales(sales).select("Store", "Sales"))
    assert "GreaterThanOrEqual(Sales,0.0)" in plan
    assert "ReadSchema: struct<Store:int,Sales:double>" in plan


def test_accuracy_report_groups_before_it_joins(spark):
    predictions = tables.materialize(
        panel.store_days(spark, SF).select(
            "Store", F.col("Sales").alias("actual_sales"), F.col("Sales").alias("predicted_sales_boosted"),
            F.lit(1.0).alias("percentage_error_boosted"),
        )
    )
    plan = plan_of(reports.competition_impact(predictions, panel.raw_stores(spark, SF)))
    assert plan.index("Join") < plan.index("keys=[Store")


def test_two_loads_keep_one_row_per_store_day_and_the_newer_figure(spark, tmp_path):
    run = lambda day: medallion.Run(spark, datetime(2025, 1, day), root=str(tmp_path / "tables"))
    names = [f.name for f in P.RAW_SALES]
    for day, more in ((1, 0), (2, 500)):
        rows = panel.raw_sales(spark, SF).select(names).filter("Store <= 3")
        rows = rows.withColumn("Sales", F.when(F.col("Sales") > 0, F.col("Sales") + more).otherwise(F.col("Sales")))
        sales, stores = str(tmp_path / f"sales{day}"), str(tmp_path / f"stores{day}")
        rows.write.option("header", True).csv(sales)
        panel.raw_stores(spark, SF).filter("Store <= 3").write.option("header", True).csv(stores)
        medallion.build_bronze(run(day), sales, stores, mode="overwrite" if day == 1 else "append")
    medallion.build_silver(run(2))
    medallion.build_gold(run(2))
    silver, gold = spark.table("silver.cleaned_sales"), spark.table("gold.demand_features")
    assert silver.count() == silver.select("Store", "Date").distinct().count()
    assert gold.count() == gold.select("Store", "Date").distinct().count() > 0
    assert silver.filter("Sales > 0 AND Sales < 500").isEmpty()
    assert spark.table("silver.cleaned_stores").count() == 4  # numbers 0 to 3
    for layer in P.LAYERS:
        spark.sql(f"DROP SCHEMA IF EXISTS {layer} CASCADE")


@pytest.fixture(scope="module")
def views(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("job")
    sales, stores = str(folder / "sales.csv"), str(folder / "stores.csv")
    panel.raw_sales(spark, SF).select([f.name for f in P.RAW_SALES]).write.option("header", True).csv(sales)
    panel.raw_stores(spark, SF).write.option("header", True).csv(stores)
    run = medallion.Run(spark, datetime(2024, 1, 1), root=str(folder / "tables"))
    small = {"forest": {"numTrees": 3, "maxDepth": 4}, "boosted": {"maxIter": 3, "maxDepth": 3}}
    return medallion.build_all(run, sales, stores, overrides=small)


def test_the_job_fills_every_table(spark, views):
    tables_built = {
        "bronze.raw_sales", "bronze.raw_stores", "bronze.data_lineage", "silver.cleaned_sales",
        "silver.cleaned_stores", "silver.data_quality_report", "silver.cleaning_audit",
        "gold.demand_features", "gold.feature_correlation_analysis", "gold.feature_dictionary",
        "gold.feature_validation_report", "gold.validation_checks", "silver.validation_checks",
        "silver.date_coverage", "gold.feature_histograms", "gold.feature_correlation_matrix",
        "ml.best_model", "ml.residual_sample", "gold.feature_importance_boosted", "ml.model_comparison",
        "ml.demand_predictions", "ml.inventory_recommendations", "ml.business_impact_analysis",
        "ml.model_runs", "analytics.data_exploration_summary", "analytics.kpi_summary",
        "analytics.accuracy_by_store_type", "analytics.savings_by_store",
        "analytics.promo_effectiveness",
    }
    for name in tables_built:
        assert not spark.table(name).isEmpty(), name


def test_validations_have_real_results(spark, views):
    checks = {r.check_name: r for r in spark.table("silver.validation_checks").collect()}
    assert checks["repeated keys"].status == "PASS" and checks["sales of unknown stores"].failures == 0
    assert {r.quality_status for r in spark.table("silver.data_quality_report").collect()} == {"cleaned"}
    broken = quality.check_report({"x": spark.range(3), "y": spark.range(0)}, datetime(2024, 1, 1))
    assert [(r.failures, r.status) for r in broken.collect()] == [(3, "FAIL"), (0, "PASS")]


def test_stored_views_say_what_the_reports_say(spark, views):
    for name, key in {
        "kpi_summary": "total_stores", "accuracy_by_store_type": "StoreType", "savings_by_store": "Store",
        "promo_effectiveness": "promo_status",
    }.items():
        assert spark.catalog.getTable(f"analytics.{name}").tableType == "VIEW"
        assert reports.stored_views().keys() >= {name}
        stored = spark.table(f"analytics.{name}")
        assert set(stored.columns) == set(views[name].columns)
        rows = lambda df: sorted(
            [tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*stored.columns).collect()],
            key=str,
        )
        assert rows(stored) == rows(views[name]), key


def test_sales_within_the_thirty_rows_do_not_move_the_forecast(spark, views):
    gold = spark.table("gold.demand_features")
    train, test = evaluate.time_split(evaluate.model_matrix(gold, [*P.HORIZON_FEATURES, "demand_volatility"]))
    model = models.fit("linear", train, P.HORIZON_FEATURES)
    sales = spark.table("silver.cleaned_sales")
    stores = spark.table("silver.cleaned_stores")

    def forecast(changed):
        again = features.build_features(changed, stores)
        rows = evaluate.model_matrix(again, [*P.HORIZON_FEATURES, "demand_volatility"])
        rows = rows.join(test.select("Store", "Date"), ["Store", "Date"])
        wide = models.prediction_table(rows, {"lr": model}, primary="lr", keep=["demand_volatility"])
        latest = inventory.latest_forecast(inventory.roll_forward(wide, "lr")).collect()
        return {r.Store: (r.latest_date, r.forecast_next_30d) for r in latest if r.latest_date}

    before = forecast(sales)
    start = spark.createDataFrame([(s, d) for s, (d, _) in before.items()], "Store int, from date")
    inside = sales.join(start, "Store", "left").withColumn(
        "Sales", F.when(F.col("Date") >= F.col("from"), F.col("Sales") * 3 + 7).otherwise(F.col("Sales"))
    )
    after = forecast(inside.drop("from"))
    assert before and after.keys() == before.keys()
    for store, (day, value) in before.items():
        assert after[store] == (day, pytest.approx(value, rel=1e-9))


def test_the_views_answer(views):
    for name, view in views.items():
        assert view.count() > 0, name
    assert views["kpi_summary"].first().total_stores == 10


def test_the_job_keeps_its_rows(spark, views):
    audit = spark.table("silver.cleaning_audit").orderBy(F.desc("step")).first()
    assert spark.table("silver.cleaned_sales").count() == audit.rows_after
    assert spark.table("bronze.data_lineage").count() == 2
    assert spark.table("ml.inventory_recommendations").count() == 10
    top = evaluate.best(spark.table("ml.model_comparison")).first()
    assert top.Model in {"Baseline", *P.MODEL_COLUMNS}


def test_each_bucket_of_the_features_is_one_file(spark, views):
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(spark.table("gold.demand_features").inputFiles()) <= buckets


def test_store_windows_over_the_saved_tables_need_no_shuffle(spark, views):
    gold = spark.table("gold.demand_features")
    assert hash_exchanges(plan_of(features.add_lags(gold.select("Store", "Date", "Sales"), "Sales", [3]))) == []
    silver = spark.table("silver.cleaned_sales").drop(*P.INGEST_COLUMNS)
    stores = spark.table("silver.cleaned_stores").drop(*P.INGEST_COLUMNS)
    assert hash_exchanges(plan_of(features.build_features(silver, stores))) == []
    report = reports.promo_analysis(spark.table("ml.demand_predictions"))
    assert "Join" not in plan_of(report)
    ahead = inventory.roll_forward(spark.table("ml.demand_predictions"))
    assert hash_exchanges(plan_of(inventory.latest_forecast(ahead))) == []
