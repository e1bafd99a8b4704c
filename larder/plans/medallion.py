"""The whole job: raw files to bronze, silver, gold, models, recommendations and dashboard views.

Each layer reads the tables of the layer before it, so a layer can be run again by itself and no
plan reaches back past the last written table.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder import params as P
from larder.operators import (
    analysis,
    cleaning,
    evaluate,
    features,
    ingest,
    inventory,
    models,
    quality,
)
from larder.plans import reports
from larder.sources import files, tables

# The features whose distribution is kept.
HISTOGRAMS = ["Sales", "sales_lag_7", "rolling_mean_30", "demand_volatility", "sales_momentum"]


@dataclass(frozen=True)
class Run:
    """One run of the job: its session, time, batch and settings.

    ``root`` places the tables under a folder; without it they go to the warehouse. ``features``
    are the models' inputs; by default only what is known on the first of the thirty rows that a
    forecast is summed over. ``buckets`` is fixed for a table's life: choose it so that a bucket
    of the feature table, sorted in one task, is a few hundred megabytes. Without it there are as
    many as shuffle partitions.
    """

    spark: SparkSession
    started_at: datetime
    root: str | None = None
    policy: P.InventoryPolicy = field(default_factory=P.InventoryPolicy)
    features: tuple[str, ...] = tuple(P.HORIZON_FEATURES)
    min_horizon_rows: int = P.FORECAST_ROWS
    buckets: int | None = None

    @property
    def batch_id(self) -> str:
        return self.started_at.strftime("%Y%m%d_%H%M%S_%f")

    def table(self, name: str) -> DataFrame:
        return self.spark.table(name)

    def path(self, name: str) -> str | None:
        return None if self.root is None else f"{self.root}/{name.replace('.', '/')}"

    def save(self, df: DataFrame, name: str, **options) -> DataFrame:
        return tables.write_table(df, name, path=self.path(name), **options)

    def add(self, df: DataFrame, name: str, step: str = "") -> DataFrame:
        """Append to a log. The run and ``step`` name the batch, so a step done again replaces
        its earlier rows."""
        batch = "-".join(filter(None, (self.batch_id, step)))
        rows = df.withColumn(P.BATCH_COLUMN, F.lit(batch))
        return tables.append_batch(rows, name, P.BATCH_COLUMN, path=self.path(name))

    def tidy(self, name: str) -> DataFrame:
        """Put a table's small files together, if it has any to put together."""
        path = tables.shared_folder(self.spark, name) if self.root is None else (
            f"{self.root}/_compacted/{name.replace('.', '/')}-{self.batch_id}"
        )
        return tables.compact(self.spark, name, path)

    def save_by_store(self, df: DataFrame, name: str, placed: bool = False) -> DataFrame:
        """Save bucketed by store, so that store windows over the table need no shuffle.

        Buckets and shuffle partitions place a store by the same hash. ``placed`` says that
        ``df`` comes out of store windows or a table with these buckets: with as many of either
        each bucket already lies within one task, and the rows are not shuffled again.
        """
        partitions = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        buckets = self.buckets or partitions
        if not placed:
            df = df.repartition(buckets, "Store")
        return self.save(df, name, bucket_by=(buckets, ["Store"]), sort_by=["Store", "Date"])

    def describe(self, name: str, text: str, **tags: str) -> None:
        tables.set_comment(self.spark, name, text)
        if tags:
            named = {k.replace("_", "."): v for k, v in tags.items()}
            tables.set_properties(self.spark, name, named)


def build_bronze(
    run: Run, sales_path: str, stores_path: str, fmt: str = "csv", mode: str = "overwrite"
) -> None:
    """Load the raw files with audit columns; records that do not fit are kept apart.

    ``mode="append"`` keeps earlier loads. A load that is tried again under the same batch replaces
    what it left before.
    """
    tables.ensure_layers(run.spark)
    sources = [
        ("raw_sales", sales_path, P.RAW_SALES, "Daily sales per store"),
        ("raw_stores", stores_path, P.RAW_STORES, "Store master data"),
    ]
    for name, path, schema, text in sources:
        raw, rejected = files.read_checked(run.spark, path, schema, fmt)
        loaded = ingest.with_ingest_metadata(
            raw, path, "retail files", text, run.batch_id, run.started_at
        )
        saved = tables.append_batch(
            loaded, f"bronze.{name}", "ingestion_batch_id", mode, path=run.path(f"bronze.{name}")
        )
        run.add(rejected.withColumn("table_name", F.lit(name)), "bronze.rejected_records", name)
        run.describe(f"bronze.{name}", text, quality_layer="bronze", last_batch=run.batch_id)
        folder, _, file = path.rstrip("/").rpartition("/")
        batch = saved.filter(F.col("ingestion_batch_id") == run.batch_id)
        kind = "initial_load" if mode == "overwrite" else "incremental_load"
        entry = ingest.lineage_row(
            batch, f"bronze_{name}", f"bronze.{name}", file, folder, run.started_at, kind
        )
        run.add(entry, "bronze.data_lineage", name)


def profile_bronze(run: Run) -> None:
    sales, stores = run.table("bronze.raw_sales"), run.table("bronze.raw_stores")
    checks = quality.violations(sales).select(
        F.col("check_name").alias("metric"), F.col("violations").cast("string").alias("value")
    )
    run.save(
        quality.profile(sales, stores).unionByName(checks), "analytics.data_exploration_summary"
    )


def build_silver(run: Run) -> None:
    """Clean sales and stores, and keep the audit of every sales rule."""
    raw = run.table("bronze.raw_sales")
    run.save(cleaning.audit_rules(raw), "silver.cleaning_audit")
    # The rows whose quantile is sought are laid out by store, so neither the flagged table nor
    # the features made from it are shuffled again.
    stage = lambda rows: run.save_by_store(rows, "silver.cleaned_sales_unflagged")
    cleaned = cleaning.clean_sales(raw, run.started_at, stage=stage)
    sales = run.save_by_store(cleaned, "silver.cleaned_sales", placed=True)
    stores = run.save(
        cleaning.clean_stores(run.table("bronze.raw_stores"), run.started_at),
        "silver.cleaned_stores",
    )
    tags = {"quality_layer": "silver", "cleaning_rules_version": P.RULES_VERSION}
    run.describe("silver.cleaned_sales", "Checked sales with business and outlier flags", **tags)
    run.describe("silver.cleaned_stores", "Checked stores with derived attributes", **tags)
    checks = run.save(
        quality.check_report(
            {
                "missing columns": quality.check_columns(sales, P.SALES_TYPES).filter(
                    "status = 'MISSING'"
                ),
                "wrong types": quality.check_types(sales, P.EXPECTED_TYPES).filter("status = 'FAIL'"),
                "repeated keys": quality.duplicate_keys(sales),
                "repeated stores": quality.duplicate_keys(stores, ["Store"]),
                "sales of unknown stores": quality.orphans(sales, stores),
                "closed with sales": quality.invalid_open_sales(sales).filter("status = 'FAIL'"),
                "negative sales": quality.ranges(sales, ["Sales"], "Sales").filter("status = 'FAIL'"),
            },
            run.started_at,
        ),
        "silver.validation_checks",
    )
    status = "cleaned" if checks.filter("status = 'FAIL'").isEmpty() else "failed"
    run.save(quality.coverage(sales), "silver.date_coverage")
    report = {"Silver Sales": sales, "Silver Stores": stores}
    run.add(quality.quality_report(report, run.started_at, status), "silver.data_quality_report")
    for name in ("silver.cleaned_sales", "silver.cleaned_stores"):
        run.tidy(name)
        tables.analyze(run.spark, name)


def build_gold(run: Run) -> None:
    sales = run.table("silver.cleaned_sales").drop(*P.INGEST_COLUMNS)
    stores = run.table("silver.cleaned_stores").drop(*P.INGEST_COLUMNS)
    built = features.build_features(sales, stores, run.started_at)
    gold = run.save_by_store(built, "gold.demand_features", placed=True)
    run.describe(
        "gold.demand_features",
        "Features per store and day",
        quality_layer="gold",
        feature_version=P.FEATURE_VERSION,
    )
    gold = run.tidy("gold.demand_features")
    tables.analyze(run.spark, "gold.demand_features", "all")
    run.save(
        analysis.top_correlations(gold, "Sales", P.CORRELATED_FEATURES),
        "gold.feature_correlation_analysis",
    )
    run.save(features.feature_coverage(gold), "gold.feature_dictionary")
    run.save(
        analysis.correlation_matrix(gold, ["Sales", *P.CORRELATED_FEATURES]),
        "gold.feature_correlation_matrix",
    )
    shapes = [
        analysis.histogram(gold, c).select(F.lit(c).alias("feature"), "*") for c in HISTOGRAMS
    ]
    run.save(reduce(DataFrame.unionByName, shapes), "gold.feature_histograms")
    run.save(
        quality.check_report(
            {
                "unfilled features": quality.critical_nulls(gold, P.CRITICAL_FEATURES).filter(
                    "status = 'FAIL'"
                ),
                "repeated keys": quality.duplicate_keys(gold),
            },
            run.started_at,
        ),
        "gold.validation_checks",
    )
    run.add(
        quality.validation_report(gold, P.CRITICAL_FEATURES, run.started_at),
        "gold.feature_validation_report",
    )


def build_models(run: Run, overrides: Mapping[str, Mapping[str, object]] | None = None) -> None:
    """Fit the three models, compare them with the moving average and save the predictions."""
    gold = run.table("gold.demand_features")
    carried = ["demand_volatility", "rolling_std_30", "rolling_mean_30", "Promo", "sales_per_customer"]
    names = [*run.features, *[c for c in carried if c not in run.features]]
    matrix = tables.materialize(evaluate.model_matrix(gold, names), "matrix")
    train, test = evaluate.time_split(matrix)
    kinds = {"boosted": "boosted", "rf": "forest", "lr": "linear"}
    fitted = {
        suffix: models.fit(kind, train, run.features, **(overrides or {}).get(kind, {}))
        for suffix, kind in kinds.items()
    }
    predicted = models.prediction_table(test, fitted, keep=carried)
    saved = run.save_by_store(predicted, "ml.demand_predictions")
    run.describe("ml.demand_predictions", "Predictions of every model on the newest days")
    columns = {"Baseline": "rolling_mean_30"} | {
        label: f"predicted_sales_{suffix}" for label, suffix in P.MODEL_COLUMNS.items()
    }
    compared = evaluate.compare_models(saved, "actual_sales", columns)
    run.save(compared, "ml.model_comparison")
    run.save(evaluate.best(run.table("ml.model_comparison")), "ml.best_model")
    run.save(
        evaluate.residuals(saved, "actual_sales", f"predicted_sales_{P.PRIMARY_MODEL}"),
        "ml.residual_sample",
    )
    run.save(
        models.importance(run.spark, fitted[P.PRIMARY_MODEL], run.features),
        "gold.feature_importance_boosted",
    )
    log_models(run, fitted, train)


def log_models(run: Run, fitted: Mapping[str, models.PipelineModel], train: DataFrame) -> None:
    """Append each model's parameters and its errors on old and new days to the run log."""
    names = {suffix: label for label, suffix in P.MODEL_COLUMNS.items()}
    on_test = {row["Model"]: row.asDict() for row in run.table("ml.model_comparison").collect()}
    on_train = evaluate.compare_models(
        models.prediction_table(train, fitted),
        "actual_sales",
        {label: f"predicted_sales_{suffix}" for suffix, label in names.items()},
    )
    train_errors = {row["Model"]: row.asDict() for row in on_train.collect()}
    for suffix, model in fitted.items():
        label = names[suffix]
        regressor = model.stages[-1]
        settings = {p.name: v for p, v in regressor.extractParamMap().items()}
        errors = {
            f"{part}_{m}": v
            for part, found in (("test", on_test), ("train", train_errors))
            for m, v in found[label].items()
            if m != "Model"
        }
        entry = evaluate.log_run(
            run.spark, label, settings | {"n_features": len(run.features)}, errors, run.started_at
        )
        run.add(entry, "ml.model_runs", suffix)


def build_recommendations(run: Run, stock: DataFrame | None = None) -> None:
    ahead = inventory.roll_forward(run.table("ml.demand_predictions"))
    latest = inventory.latest_forecast(ahead, run.min_horizon_rows)
    at = F.lit(run.started_at)
    advice = inventory.recommend(inventory.optimize(latest, stock, run.policy), at)
    saved = run.save(inventory.graded_priority(advice), "ml.inventory_recommendations")
    run.describe("ml.inventory_recommendations", "Stock levels and actions per store")
    run.save(inventory.urgent(saved), "ml.urgent_orders")
    impact = inventory.business_impact(saved, run.policy, at)
    run.add(impact, "ml.business_impact_analysis")
    run.describe("ml.business_impact_analysis", "Savings and avoided stock-outs over time")


def build_reports(run: Run) -> dict[str, DataFrame]:
    """The dashboard queries as session views; those that other sessions read as stored views,
    which follow the tables."""
    predictions = run.table("ml.demand_predictions")
    stores = run.table("silver.cleaned_stores")
    advice = run.table("ml.inventory_recommendations")
    kpis = reports.kpi_summary(predictions)
    views = {
        "kpi_summary": kpis,
        "kpi_cards": reports.kpi_cards(kpis),
        "top_accurate": reports.top_accurate(predictions),
        "accuracy_by_store_type": reports.accuracy_by_type(predictions, stores),
        "stockout_alerts": reports.stockout_alerts(advice),
        "savings_by_store": reports.savings_by_store(advice, run.policy),
        "savings_total": reports.savings_total(advice, run.policy),
        "weekly_trend": reports.weekly_trend(predictions),
        "importance_rank": reports.importance_rank(run.table("gold.feature_importance_boosted")),
        "promo_effectiveness": reports.promo_analysis(predictions),
        "competition_impact": reports.competition_impact(predictions, stores),
        "impact_latest": reports.impact_latest(run.table("ml.business_impact_analysis")),
    }
    for name, statement in reports.stored_views(run.policy).items():
        tables.persist_view(run.spark, f"analytics.{name}", statement)
    return {name: tables.register_view(df, name) for name, df in views.items()}


def build_all(
    run: Run,
    sales_path: str,
    stores_path: str,
    fmt: str = "csv",
    stock: DataFrame | None = None,
    overrides: Mapping[str, Mapping[str, object]] | None = None,
) -> dict[str, DataFrame]:
    """The whole job. Its steps' files are removed at the end; its tables and views stay."""
    before = tables.steps(run.spark)
    build_bronze(run, sales_path, stores_path, fmt)
    profile_bronze(run)
    build_silver(run)
    build_gold(run)
    build_models(run, overrides)
    build_recommendations(run, stock)
    views = build_reports(run)
    tables.release(run.spark, keep=before)
    return views
