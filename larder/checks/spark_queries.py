"""One query per operator over the generated tables, each a function of (spark, sf_dir).

Wall-clock columns are left out and inexact doubles rounded, so that another engine can be
expected to return the same values.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder import params as P
from larder.functions import columns
from larder.functions.columns import keep_compiled, round_half_up
from larder.operators import (
    analysis,
    cleaning,
    evaluate,
    features,
    ingest,
    inventory,
    models,
    moments,
    quality,
    quantile,
    trees,
)
from larder.plans import reports, rollups
from larder.sources import files, panel, tables

AT = datetime(2024, 1, 1)
TIMES = [
    "processing_timestamp",
    "store_processing_timestamp",
    "feature_engineering_timestamp",
    "recommendation_timestamp",
    "analysis_date",
    "validated_at",
    "ingestion_timestamp",
]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]):
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    """Round the given columns, or all doubles; adding 0.0 turns a negative zero positive."""
    kinds = dict(df.dtypes)
    keep_compiled(df.sparkSession)

    def shortened(c: str) -> Column:
        if kinds[c] != "double":
            return F.round(c, digits)
        return round_half_up(F.col(c), digits)

    names = columns or [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: shortened(c) + F.lit(0.0) for c in names})


def timeless(df: DataFrame) -> DataFrame:
    return df.drop(*TIMES)


def scratch(name: str) -> str:
    return f"larder_{name}_{uuid.uuid4().hex[:12]}"


def saved(df: DataFrame, name: str, **options: object) -> tuple[str, DataFrame]:
    """Save a scratch table in the shared folder."""
    table = scratch(name)
    path = tables.shared_folder(df.sparkSession, name)
    return table, tables.write_table(df, table, path=path, **options)


_KEPT: dict[tuple, object] = {}


def once(spark: SparkSession, *key: object, make: Callable[[], object]) -> object:
    """What several queries of a session need and is slow to make: training rows, fitted models.

    Made anew after steps were released, as it may read them.
    """
    full = (spark.sparkContext.applicationId, tables.releases(spark), *key)
    if full not in _KEPT:
        _KEPT[full] = make()
    return _KEPT[full]


def forget() -> None:
    """Make what queries share anew when next asked for; for timing a query from the raw files."""
    _KEPT.clear()


# --- inputs ----------------------------------------------------------------------------------


def silver_sales(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.apply_sales_rules(panel.raw_sales(spark, sf))


def silver_stores(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.clean_stores(panel.raw_stores(spark, sf), AT)


def gold(spark: SparkSession, sf: str) -> DataFrame:
    sales = panel.dealt(silver_sales(spark, sf), panel.tasks(spark, sf), "Store")
    return features.build_features(sales, silver_stores(spark, sf), AT)


# Sales thirty rows earlier: like every forecast that is summed over the next thirty rows, it is
# known on the first of them.
FORECAST = "lag30"
FORECAST_INPUTS = [
    "Store",
    "Date",
    "Sales",
    "Promo",
    "sales_lag_30",
    "sales_lag_60",
    "sales_lag_90",
    "demand_volatility",
    "rolling_std_30",
    "sales_per_customer",
]


def gold_table(spark: SparkSession, sf: str) -> DataFrame:
    """The features forecasts and reports need: written once a session, as the job's table is."""
    return once(
        spark, sf, "gold",
        make=lambda: tables.materialize(gold(spark, sf).select(*FORECAST_INPUTS), "gold"),
    )


def forecasts(features_table: DataFrame, *keep: str) -> DataFrame:
    """The newest fifth of the days with three forecasts that need no training."""
    _, newest = evaluate.time_split(features_table)
    wide = newest.select(
        "Store",
        "Date",
        F.col("Sales").alias("actual_sales"),
        *[F.col(f"sales_lag_{k}").alias(f"predicted_sales_lag{k}") for k in (30, 60, 90)],
        *keep,
    )
    return evaluate.add_errors(wide, FORECAST)


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    return forecasts(gold_table(spark, sf))


def latest(spark: SparkSession, sf: str, rows: int = P.FORECAST_ROWS) -> DataFrame:
    known = gold_table(spark, sf)
    # The forecasts carry the volatility along, which saves joining it on again.
    carried = forecasts(known, "demand_volatility")
    return inventory.latest_forecast(inventory.roll_forward(carried, FORECAST), rows)


def stock_plan(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.optimize(latest(spark, sf))


def recommendations(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.recommend(stock_plan(spark, sf), F.lit(AT))


def exact_recommendations(spark: SparkSession, sf: str) -> DataFrame:
    """Recommendations whose amounts are free of summation noise, so that rounding them to whole
    units gives the same on every engine."""
    return rounded(recommendations(spark, sf), digits=5)


def with_unknown_stores(df: DataFrame) -> DataFrame:
    """All rows, and those of each month's first day once more under stores that don't exist."""
    strays = df.filter(F.dayofmonth("Date") == 1).withColumn("Store", -F.col("Store"))
    return df.unionByName(strays)


# --- sources, sinks, catalog -----------------------------------------------------------------


def _checked_csv(spark, sf):
    """The sales as CSV beside a file with a line for each store that does not fit."""
    path = tables.shared_folder(spark, "scan_csv")
    source = panel.raw_sales(spark, sf)
    source.write.option("header", True).csv(path)
    broken = panel.raw_stores(spark, sf).select("Store", F.lit("oops").alias("DayOfWeek"))
    broken.write.mode("append").option("header", True).csv(path)
    return files.read_checked(spark, path, source.schema)


@query
def scan_csv(spark, sf):
    """Lines that do not fit are left out."""
    return _checked_csv(spark, sf)[0]


@query
def scan_rejected(spark, sf):
    """Lines that do not fit are kept."""
    return _checked_csv(spark, sf)[1].select("record", "fields_read")


@query
def scan_format_guard(spark, sf):
    source = panel.raw_sales(spark, sf)
    copies = {}
    for fmt in files.FORMATS:
        path = tables.shared_folder(spark, f"scan_{fmt}")
        writer = source.write.format(fmt)
        (writer.option("header", True) if fmt == "csv" else writer).save(path)
        copies[fmt] = files.read_raw(spark, path, fmt, source.schema)
    return quality.row_counts(copies)


@query
def scan_table(spark, sf):
    table, _ = saved(panel.store_days(spark, sf), "scan_table")
    return spark.table(table)


@query
def bronze_ingest(spark, sf):
    loaded = ingest.with_ingest_metadata(
        panel.raw_sales(spark, sf), "sales.csv", "shop", "daily sales", "20240101_000000", AT
    )
    return timeless(loaded)


@query
def row_hash(spark, sf):
    raw = panel.raw_sales(spark, sf)
    return raw.select(
        "Store",
        "Date",
        columns.row_hash(raw.columns).alias("row_hash"),
        columns.row_hash(raw.columns, "<null>").alias("row_hash_with_nulls"),
    )


@query
def sink_overwrite(spark, sf):
    panel_rows = panel.store_days(spark, sf)
    table, _ = saved(panel_rows.filter("Promo = 1").select("Store", "Date"), "overwrite")
    path = tables.shared_folder(spark, "overwrite")
    return tables.write_table(panel_rows, table, path=path)


@query
def sink_append(spark, sf):
    """Two batches, of which the second is tried twice, with other rows the first time."""
    counts = quality.freq(panel.store_days(spark, sf), "Store").withColumnRenamed("count", "days")
    table, path = scratch("append"), tables.shared_folder(spark, "append")
    for batch, rows in (
        ("first", counts),
        ("second", counts.filter("Store % 2 = 0").withColumn("days", F.col("days") + 1)),
        ("second", counts.select("days", "Store")),
    ):
        saved_rows = tables.append_batch(
            rows.withColumn("batch", F.lit(batch)), table, "batch", path=path
        )
    return saved_rows


@query
def lineage_record(spark, sf):
    loads = [
        (panel.raw_sales(spark, sf), "bronze_raw_sales", "bronze.raw_sales", "sales.csv"),
        (panel.raw_stores(spark, sf), "bronze_raw_stores", "bronze.raw_stores", "stores.csv"),
    ]
    sales, stores = (
        ingest.lineage_row(df, name, full, file, "raw/", "2024-01-01 00:00:00")
        for df, name, full, file in loads
    )
    return sales.unionByName(stores)


@query
def table_properties(spark, sf):
    table, rows = saved(panel.store_days(spark, sf), "properties")
    tags = {"quality.layer": "bronze", "feature.version": "v1.0"}
    stored = tables.set_properties(spark, table, tags).filter(F.col("key").isin(*tags))
    return stored.withColumn("record_count", rows.agg(F.count("*")).scalar())


@query
def table_comment(spark, sf):
    table, rows = saved(panel.store_days(spark, sf), "comment")
    stored = tables.set_comment(spark, table, "Sales per store and day, the owner's copy")
    return stored.select("comment").withColumn("record_count", rows.agg(F.count("*")).scalar())


@query
def compact_table(spark, sf):
    """A bucketed table of many small files: rows stay, and every bucket is one file."""
    rows = panel.store_days(spark, sf).repartition(16)
    table, before = saved(rows, "compact", bucket_by=(4, ["Store"]), sort_by=["Store", "Date"])
    after = tables.compact(spark, table, tables.shared_folder(spark, "compacted"))
    files_of = F.count_distinct("_metadata.file_path")
    shrunk = before.agg(files_of).scalar() > after.agg(files_of).scalar()
    bucket = F.pmod(F.hash("Store"), F.lit(4))
    spread = after.groupBy(bucket.alias("bucket")).agg(files_of.alias("files"))
    single = spread.agg(F.max("files")).scalar() == 1
    return after.withColumns({"fewer_files": shrunk, "one_file_a_bucket": single})


@query
def table_stats(spark, sf):
    table, _ = saved(panel.store_days(spark, sf), "stats")
    return tables.analyze(spark, table, "all").select("row_count")


@query
def layer_schemas(spark, sf):
    layers = tables.ensure_layers(spark).filter(F.col("namespace").isin(*P.LAYERS))
    table = f"silver.{scratch('layers')}"
    path = tables.shared_folder(spark, "layers")
    rows = tables.write_table(panel.store_days(spark, sf), table, path=path)
    held = F.when(F.col("namespace") == "silver", rows.agg(F.count("*")).scalar()).otherwise(0)
    return layers.withColumn("record_count", held)


@query
def create_view(spark, sf):
    table, _ = saved(panel.store_days(spark, sf), "store_days")
    counted = f"SELECT Store, count(*) AS days, sum(Sales) AS sales FROM {table} GROUP BY Store"
    return tables.persist_view(spark, scratch("days_per_store"), counted)


@query
def literal_table(spark, sf):
    return quality.to_rows(
        panel.store_days(spark, sf).agg(F.count("*").alias("n"), F.sum("Sales").alias("s")),
        [
            {"metric": F.lit("rows"), "value": F.col("n").cast("string")},
            {"metric": F.lit("sales"), "value": F.col("s").cast("bigint").cast("string")},
        ],
    )


@query
def preview(spark, sf):
    return tables.preview(panel.store_days(spark, sf), ["Store", "Date"], 10)


# --- profiling and data quality --------------------------------------------------------------


@query
def profile_summary(spark, sf):
    return quality.profile(panel.raw_sales(spark, sf), panel.raw_stores(spark, sf))


@query
def row_count_union(spark, sf):
    return quality.row_counts(
        {"Sales": panel.raw_sales(spark, sf), "Stores": panel.raw_stores(spark, sf)}
    )


@query
def null_profile(spark, sf):
    return quality.null_counts(panel.raw_sales(spark, sf))


@query
def describe_stats(spark, sf):
    return rounded(quality.describe(panel.raw_sales(spark, sf), ["Sales", "Customers"]))


@query
def freq_count(spark, sf):
    raw = panel.raw_sales(spark, sf)
    by_open = quality.freq(raw, "Open").select(F.lit("Open").alias("column"), F.col("Open").alias("value"), "count")
    by_promo = quality.freq(raw, "Promo").select(F.lit("Promo").alias("column"), F.col("Promo").alias("value"), "count")
    return by_open.unionByName(by_promo)


@query
def freq_count_desc(spark, sf):
    return quality.freq(panel.raw_stores(spark, sf), "StoreType", by="count")


@query
def dow_sales(spark, sf):
    return quality.sales_by_weekday(panel.raw_sales(spark, sf))


@query
def quality_counts(spark, sf):
    return quality.violations(panel.raw_sales(spark, sf))


@query
def dup_keys(spark, sf):
    return quality.duplicate_keys(panel.raw_sales(spark, sf))


@query
def date_coverage(spark, sf):
    return quality.coverage(panel.raw_sales(spark, sf))


@query
def schema_check(spark, sf):
    expected = [f.name for f in P.RAW_SALES] + P.INGEST_COLUMNS
    return quality.check_columns(panel.raw_sales(spark, sf), expected)


@query
def type_check(spark, sf):
    return quality.check_types(panel.raw_sales(spark, sf), P.EXPECTED_TYPES | {"Region": "string"})


@query
def quality_metrics(spark, sf):
    return rounded(quality.quality_metrics(panel.raw_sales(spark, sf)))


@query
def bronze_summary(spark, sf):
    return rounded(quality.bronze_summary(panel.raw_sales(spark, sf)))


@query
def range_check(spark, sf):
    return quality.ranges(silver_sales(spark, sf), ["Sales", "Date", "Customers"], "Sales")


@query
def feature_range_check(spark, sf):
    return rounded(quality.ranges(gold(spark, sf), P.RANGED_FEATURES))


@query
def orphan_check(spark, sf):
    return quality.orphans(
        with_unknown_stores(panel.raw_sales(spark, sf)), panel.raw_stores(spark, sf)
    )


@query
def invalid_open_sales(spark, sf):
    return quality.invalid_open_sales(silver_sales(spark, sf))


@query
def quality_report(spark, sf):
    layer = {"Silver Sales": silver_sales(spark, sf), "Silver Stores": silver_stores(spark, sf)}
    return timeless(quality.quality_report(layer, AT))


@query
def null_verdict(spark, sf):
    return quality.critical_nulls(gold(spark, sf), [*P.CRITICAL_FEATURES, "rolling_std_90", "sales_lag_365"])


@query
def validation_report(spark, sf):
    return timeless(quality.validation_report(gold(spark, sf), P.CRITICAL_FEATURES, AT))


# --- silver: sales ---------------------------------------------------------------------------


def _text_dates(spark, sf):
    """Raw sales with dates as text, some of which are no dates."""
    bad = F.when(F.col("Customers") > 70, F.lit("2013-13-01"))
    return panel.raw_sales(spark, sf).withColumn(
        "Date", F.coalesce(bad, F.date_format("Date", P.DATE_FORMAT))
    )


@query
def parse_date(spark, sf):
    return cleaning.standardize_date(_text_dates(spark, sf)).select("Store", "Date", "Sales")


@query
def drop_closed_sales(spark, sf):
    return cleaning.drop_closed_sales(panel.raw_sales(spark, sf))


@query
def drop_negative_sales(spark, sf):
    return cleaning.drop_negative_sales(panel.raw_sales(spark, sf))


@query
def drop_null_critical(spark, sf):
    return cleaning.drop_null_critical(panel.raw_sales(spark, sf))


@query
def dedupe_key(spark, sf):
    return cleaning.dedupe(panel.raw_sales(spark, sf))


@query
def dedupe_latest_load(spark, sf):
    """Two loads of the same days: the second corrects some stores and forgets some customers."""
    first = panel.store_days(spark, sf).withColumn("ingestion_timestamp", F.lit(AT))
    second = first.filter("Store % 2 = 0").withColumns(
        {
            "Sales": F.col("Sales") + 1,
            "Customers": F.when(F.col("Promo") == 1, F.col("Customers")),
            "ingestion_timestamp": F.lit(AT + timedelta(days=1)),
        }
    )
    fuller = second.withColumn("Customers", F.lit(7))  # the same load, without gaps
    return timeless(cleaning.dedupe(first.unionByName(second).unionByName(fuller)))


@query
def dedupe_differing_copies(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"
    )
    return cleaning.dedupe(
        lines, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity"]
    )


@query
def standardize_types(spark, sf):
    text = panel.raw_sales(spark, sf).withColumns(
        {c: F.col(c).cast("string") for c in P.SALES_TYPES}
    )
    broken = F.when(F.col("Promo") == "1", F.lit("yes")).otherwise(F.col("Promo"))
    return cleaning.standardize_types(text.withColumn("Promo", broken))


@query
def holiday_decode(spark, sf):
    return cleaning.decode(panel.raw_sales(spark, sf), "StateHoliday").select(
        "Store", "Date", "StateHoliday"
    )


@query
def business_flags(spark, sf):
    decoded = cleaning.decode(panel.raw_sales(spark, sf), "StateHoliday")
    return cleaning.business_flags(decoded).select(
        "Store", "Date", "is_holiday", "is_promo_day", "is_open", "has_customers"
    )


@query
def flag_outliers(spark, sf):
    days = tables.materialize(panel.store_days(spark, sf), "days")
    return quantile.flag_above_quantile(days, "Sales", 0.99).select(
        "Store", "Date", "Sales", "is_outlier"
    )


@query
def exact_quantile(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    at = [0.0, 0.5, 0.99, 1.0]
    return rounded(quantile.exact_quantile(lines, "l_extendedprice", at), "quantile")


@query
def processing_metadata(spark, sf):
    return timeless(cleaning.stamp(panel.raw_stores(spark, sf), AT))


@query
def rule_audit(spark, sf):
    return rounded(cleaning.audit_rules(panel.raw_sales(spark, sf)))


@query
def clean_sales(spark, sf):
    return timeless(cleaning.clean_sales(_text_dates(spark, sf), AT, stage=tables.materialize))


# --- silver: stores --------------------------------------------------------------------------


def _stores_with_gaps(spark, sf):
    """Raw stores, and each of them once more without its number."""
    stores = panel.raw_stores(spark, sf)
    return stores.unionByName(stores.withColumn("Store", F.lit(None).cast("int")))


@query
def drop_null_store(spark, sf):
    return cleaning.drop_null_store(_stores_with_gaps(spark, sf))


@query
def normalize_categories(spark, sf):
    return cleaning.normalize_categories(panel.raw_stores(spark, sf))


@query
def fill_competition(spark, sf):
    return cleaning.fill_competition(panel.raw_stores(spark, sf))


@query
def fill_promo2(spark, sf):
    return cleaning.fill_promo2(panel.raw_stores(spark, sf))


@query
def store_derived(spark, sf):
    filled = cleaning.fill_competition(panel.raw_stores(spark, sf))
    return cleaning.store_derived(filled).select(
        "Store", "has_competition", "in_promo2", "competition_distance_km", "store_category"
    )


@query
def competition_bucket(spark, sf):
    return cleaning.competition_bucket(panel.raw_stores(spark, sf)).select(
        "Store", "CompetitionDistance", "competition_proximity"
    )


@query
def clean_stores(spark, sf):
    return timeless(cleaning.clean_stores(_stores_with_gaps(spark, sf), AT))


# --- gold: features --------------------------------------------------------------------------


def _with(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select("Store", "Date", *names)


@query
def join_store_dim(spark, sf):
    fact = cleaning.stamp(with_unknown_stores(panel.store_days(spark, sf)), AT)
    return timeless(features.join_dim(fact, silver_stores(spark, sf)))


@query
def calendar_parts(spark, sf):
    return _with(
        features.add_calendar(panel.store_days(spark, sf)),
        ["year", "month", "day", "day_of_week", "week_of_year", "quarter"],
    )


@query
def calendar_flags(spark, sf):
    return _with(
        features.add_calendar(panel.store_days(spark, sf)),
        ["is_weekend", "is_month_start", "is_month_end", "days_in_month"],
    )


@query
def season_label(spark, sf):
    return _with(features.add_calendar(panel.store_days(spark, sf)), ["season"])


@query
def season_number(spark, sf):
    return _with(features.add_calendar(panel.store_days(spark, sf)), ["season_num"])


@query
def lag_features(spark, sf):
    lagged = features.add_lags(panel.store_days(spark, sf), "Sales", P.SALES_LAGS)
    return _with(lagged, [f"sales_lag_{k}" for k in P.SALES_LAGS])


@query
def lag_features_calendar(spark, sf):
    lagged = features.add_lags(panel.store_days(spark, sf), "Sales", [1, 7, 30], calendar=True)
    return _with(lagged, ["sales_lag_1", "sales_lag_7", "sales_lag_30"])


@query
def customer_lags(spark, sf):
    lagged = features.add_lags(panel.store_days(spark, sf), "Customers", P.CUSTOMER_LAGS)
    return _with(lagged, [f"customers_lag_{k}" for k in P.CUSTOMER_LAGS])


@query
def rolling_mean(spark, sf):
    rolled = features.add_rolling(panel.store_days(spark, sf), "Sales", "mean", P.MEAN_WINDOWS)
    return _with(rolled, [f"rolling_mean_{k}" for k in P.MEAN_WINDOWS])


@query
def rolling_mean_calendar(spark, sf):
    rolled = features.add_rolling(
        panel.store_days(spark, sf), "Sales", "mean", [7, 30], calendar=True
    )
    return _with(rolled, ["rolling_mean_7", "rolling_mean_30"])


@query
def rolling_std(spark, sf):
    rolled = features.add_rolling(panel.store_days(spark, sf), "Sales", "std", P.STD_WINDOWS)
    return rounded(_with(rolled, [f"rolling_std_{k}" for k in P.STD_WINDOWS]))


@query
def rolling_moments(spark, sf):
    rolled = features.add_rolling_moments(
        panel.store_days(spark, sf), "Sales", P.MEAN_WINDOWS, P.STD_WINDOWS
    )
    names = [f"rolling_mean_{k}" for k in P.MEAN_WINDOWS]
    names += [f"rolling_std_{k}" for k in P.STD_WINDOWS]
    return rounded(_with(rolled, names))


@query
def rolling_min_max(spark, sf):
    rolled = features.add_rolling(panel.store_days(spark, sf), "Sales", "min", [30])
    rolled = features.add_rolling(rolled, "Sales", "max", [30])
    return _with(rolled, ["rolling_min_30", "rolling_max_30"])


@query
def rolling_median(spark, sf):
    rolled = features.add_rolling(panel.store_days(spark, sf), "Sales", "median", [30])
    return _with(rolled, ["rolling_median_30"])


@query
def rolling_customers(spark, sf):
    rolled = features.add_rolling(
        panel.store_days(spark, sf), "Customers", "mean", [30], "rolling_customers_{stat}_{k}"
    )
    return _with(rolled, ["rolling_customers_mean_30"])


@query
def growth_rates(spark, sf):
    lagged = features.add_lags(silver_sales(spark, sf), "Sales", P.GROWTH_LAGS)
    grown = features.add_growth(lagged, "Sales", P.GROWTH_LAGS)
    return rounded(_with(grown, [f"sales_growth_{k}d" for k in P.GROWTH_LAGS]))


def _rolled(spark, sf):
    return features.add_rolling_features(silver_sales(spark, sf))


@query
def demand_volatility(spark, sf):
    return rounded(_with(features.add_volatility(_rolled(spark, sf)), ["demand_volatility"]))


@query
def sales_momentum(spark, sf):
    return rounded(_with(features.add_momentum(_rolled(spark, sf)), ["sales_momentum"]))


@query
def trend_direction(spark, sf):
    return _with(features.add_momentum(_rolled(spark, sf)), ["trend_direction"])


@query
def cyclic_encoding(spark, sf):
    cyclic = features.add_cyclic(features.add_calendar(panel.store_days(spark, sf)))
    return rounded(_with(cyclic, P.FEATURE_CATEGORIES["Cyclic Encoding Features"]))


@query
def competition_pressure(spark, sf):
    scored = features.add_competition_pressure(silver_stores(spark, sf))
    return scored.select("Store", "CompetitionDistance", "competition_pressure")


@query
def store_tier(spark, sf):
    tiered = features.add_tier(features.add_store_average(panel.store_days(spark, sf)))
    return _with(tiered, ["avg_sales_per_store", "store_performance_tier"])


@query
def sales_per_customer(spark, sf):
    return rounded(
        _with(features.add_sales_per_customer(silver_sales(spark, sf)), ["sales_per_customer"])
    )


@query
def promo_label(spark, sf):
    return _with(features.add_promo_effect(_rolled(spark, sf)), ["promo_effectiveness"])


@query
def promo_frequency(spark, sf):
    return _with(_rolled(spark, sf), ["promo_frequency_30d"])


@query
def potential_stockout(spark, sf):
    flagged = features.add_potential_stockout(silver_sales(spark, sf), 3000, 20)
    return _with(flagged, ["potential_stockout"])


@query
def holiday_multiplier(spark, sf):
    return rounded(
        _with(features.add_holiday_multiplier(_rolled(spark, sf)), ["holiday_sales_multiplier"])
    )


@query
def assortment_score(spark, sf):
    return features.add_store_scores(silver_stores(spark, sf)).select(
        "Store", "Assortment", "assortment_score"
    )


@query
def store_type_score(spark, sf):
    return features.add_store_scores(silver_stores(spark, sf)).select(
        "Store", "StoreType", "store_type_score"
    )


def _lagged_and_rolled(spark, sf):
    lagged = features.add_lags(panel.store_days(spark, sf), "Sales", [7, 30])
    return features.add_rolling(lagged, "Sales", "mean", [7, 30])


@query
def warmup_filter(spark, sf):
    return _with(features.drop_warmup(_lagged_and_rolled(spark, sf)), P.WARMUP_COLUMNS)


@query
def warmup_retention(spark, sf):
    return rounded(features.warmup_retention(_lagged_and_rolled(spark, sf)))


@query
def feature_metadata(spark, sf):
    calendar = features.add_calendar(panel.store_days(spark, sf))
    return timeless(features.stamp_features(calendar, AT)).select(
        "Store", "Date", "feature_version", "total_features"
    )


@query
def feature_dictionary(spark, sf):
    return features.feature_coverage(gold(spark, sf))


@query
def feature_summary(spark, sf):
    return features.feature_counts(features.feature_coverage(gold(spark, sf)))


@query
def build_features(spark, sf):
    return rounded(timeless(gold(spark, sf)))


# --- feature analysis ------------------------------------------------------------------------


@query
def corr_topk(spark, sf):
    return rounded(analysis.top_correlations(gold(spark, sf), "Sales", P.CORRELATED_FEATURES))


@query
def corr_matrix(spark, sf):
    names = ["Sales", *P.CORRELATED_FEATURES]
    known = tables.materialize(gold(spark, sf).select(*names), "correlated")
    return rounded(analysis.correlation_matrix(known, names))


@query
def sample_rows(spark, sf):
    return analysis.sample_rows(panel.store_days(spark, sf), ["Store", "Date"], 0.01)


@query
def histogram(spark, sf):
    days = tables.materialize(panel.store_days(spark, sf), "days")
    return rounded(analysis.histogram(days, "Sales"), "lower_edge", "upper_edge")


# --- training set and evaluation -------------------------------------------------------------


@query
def model_matrix(spark, sf):
    return rounded(evaluate.model_matrix(gold(spark, sf), P.REFERENCE_FEATURES))


@query
def time_split(spark, sf):
    days = tables.materialize(panel.store_days(spark, sf), "days")
    train, test = evaluate.time_split(days)
    return quality.row_counts({"train": train, "test": test}).withColumn(
        "cut", evaluate.split_date(days).scalar()
    )


@query
def regression_metrics(spark, sf):
    measured = evaluate.metrics(
        predictions(spark, sf), "actual_sales", f"predicted_sales_{FORECAST}", by=["Store"]
    )
    return rounded(measured, digits=6)  # means of eighths over a hundred rows end by the fifth


@query
def baseline_forecast(spark, sf):
    rolled = features.add_rolling(panel.store_days(spark, sf), "Sales", "mean", [30])
    return _with(evaluate.predict_moving_average(rolled), ["predicted_sales_baseline"])


@query
def prediction_errors(spark, sf):
    return rounded(predictions(spark, sf))


@query
def residual_sample(spark, sf):
    return rounded(
        evaluate.residuals(predictions(spark, sf), "actual_sales", f"predicted_sales_{FORECAST}")
    )


def _comparison(spark, sf):
    return evaluate.compare_models(
        predictions(spark, sf),
        "actual_sales",
        {
            "30-row lag": f"predicted_sales_{FORECAST}",
            "60-row lag": "predicted_sales_lag60",
            "90-row lag": "predicted_sales_lag90",
        },
    )


@query
def model_comparison(spark, sf):
    return rounded(_comparison(spark, sf))


@query
def best_model(spark, sf):
    return rounded(evaluate.best(_comparison(spark, sf)))


@query
def model_run_log(spark, sf):
    runs = [
        evaluate.log_run(
            spark,
            measured["Model"],
            {"lag": int(measured["Model"].split("-")[0])},
            {f"test_{k}": v for k, v in measured.asDict().items() if k != "Model"},
            AT,
        )
        for measured in rounded(_comparison(spark, sf)).collect()
    ]
    name, path = scratch("run_log"), tables.shared_folder(spark, "run_log")
    for run in [*runs, *runs]:  # a run that is logged again replaces its entry
        log = tables.append_batch(
            run.withColumn("batch", F.col("run")), name, "batch", path=path
        )
    return log.select("run", F.explode("metrics").alias("metric", "value"))


# --- models ----------------------------------------------------------------------------------


def _matrix_split(spark, sf, names=P.SAFE_FEATURES):
    """Training and test rows, written once because fitting reads them many times."""
    matrix = once(
        spark, sf, "matrix", *names,
        make=lambda: tables.materialize(evaluate.model_matrix(gold(spark, sf), names), "matrix"),
    )
    return evaluate.time_split(matrix)


def _fitted(spark, sf, kind, names=P.SAFE_FEATURES):
    """A model with its stated parameters on all of its inputs."""
    train, _ = _matrix_split(spark, sf, names)
    return once(spark, sf, kind, *names, make=lambda: models.fit(kind, train, names))


def _checked(spark, sf, kind):
    """A small model of the same kind, which SQL can fit alike."""
    train, _ = _matrix_split(spark, sf)
    small = {"forest": P.CHECKED_FOREST, "boosted": P.CHECKED_BOOSTED}[kind]
    return once(
        spark, sf, "checked", kind,
        make=lambda: models.fit(
            kind, train, P.CHECKED_FEATURES, prediction=f"checked_{kind}", **small
        ),
    )


def _against_mean(spark, sf, kind, names=P.SAFE_FEATURES):
    """Scored test rows, the training mean's error on the rows learned from, whether the stated
    model has a smaller one there, and the small model's error. On the test rows the stated model
    has no smaller one: the test data's sales are noise."""
    train, test = _matrix_split(spark, sf, names)
    model = _fitted(spark, sf, kind, names)
    sides = train.withColumn("part", F.lit("train")).unionByName(
        test.withColumn("part", F.lit("test"))
    )
    both = models.score(_checked(spark, sf, kind), models.score(model, sides))
    old = F.col("part") == "train"
    error = F.when(old, F.col("Sales") - F.col("prediction"))
    checked = F.when(old, F.col("Sales") - F.col(f"checked_{kind}"))
    return both.agg(
        F.count(F.when(~old & ~F.isnan("prediction"), 1)).alias("rows"),
        F.stddev_pop(F.when(old, F.col("Sales"))).alias("flat"),
        F.sqrt(F.avg(error * error)).alias("model"),
        F.sqrt(F.avg(checked * checked)).alias("checked"),
    ).select(
        "rows",
        F.round("flat", 4).alias("mean_RMSE"),
        (F.col("model") < F.col("flat")).alias("beats_mean"),
        F.round("checked", 4).alias("checked_RMSE"),
    )


@query
def fit_linear(spark, sf):
    """All inputs: least squares leaves no mean error, and no more than one input alone does."""
    train, _ = _matrix_split(spark, sf)
    both = models.score(_fitted(spark, sf, "linear"), train).withColumnRenamed("prediction", "all")
    one = models.fit("linear", train, ["rolling_mean_30"])
    measured = models.score(one, both).agg(
        F.count("*").alias("rows"),
        F.sqrt(F.avg((F.col("Sales") - F.col("prediction")) ** 2)).alias("one"),
        F.sqrt(F.avg((F.col("Sales") - F.col("all")) ** 2)).alias("all"),
        F.avg("all").alias("mean"),
    )
    return measured.select(
        "rows",
        F.round("one", 3).alias("one_input_RMSE"),
        F.round("mean", 2).alias("mean_prediction"),
        (F.col("all") <= F.col("one") * 1.000001).alias("no_worse_than_one_input"),
    )


@query
def fit_linear_merged(spark, sf):
    """Least squares from stored moments of two halves of the training rows."""
    train, _ = _matrix_split(spark, sf)
    columns = [*P.SAFE_FEATURES, "Sales"]
    halves = [
        tables.materialize(moments.co_moments(train.filter(F.col("Store") % 2 == side), columns))
        for side in (0, 1)
    ]
    whole = moments.merge(halves[0].unionByName(halves[1]))
    coefficients, intercept = moments.linear(spark, whole, P.SAFE_FEATURES)
    return rounded(coefficients.withColumn("intercept", F.lit(intercept)))


@query
def fit_linear_one_input(spark, sf):
    train, _ = _matrix_split(spark, sf, ["rolling_mean_30"])
    model = models.fit("linear", train, ["rolling_mean_30"])
    fitted = models.importance(spark, model, ["rolling_mean_30"])
    intercept = F.lit(float(model.stages[-1].intercept))
    return rounded(fitted.select("coefficient", intercept.alias("intercept")), digits=3)


@query
def score(spark, sf):
    """Least squares on all inputs, applied to the test rows."""
    _, test = _matrix_split(spark, sf)
    scored = models.score(_fitted(spark, sf, "linear"), test)
    return rounded(scored.select("Store", "Date", "Sales", "prediction"), "prediction", digits=1)


@query
def score_nodes(spark, sf):
    """Small ensembles as tables of nodes, applied by joins."""
    _, test = _matrix_split(spark, sf)

    def scored(kind):
        model = _checked(spark, sf, kind)
        nodes = trees.node_table(spark, model, P.CHECKED_FEATURES)
        return trees.score_nodes(
            nodes, test, P.CHECKED_FEATURES, trees.depth(model), P.SALES_KEY, kind
        )

    return rounded(scored("forest").join(scored("boosted"), P.SALES_KEY), digits=2)


@query
def score_one_input(spark, sf):
    train, test = _matrix_split(spark, sf, ["rolling_mean_30"])
    model = models.fit("linear", train, ["rolling_mean_30"])
    return rounded(models.score(model, test).select("Store", "Date", "prediction"), digits=2)


@query
def fit_forest(spark, sf):
    return _against_mean(spark, sf, "forest")


@query
def fit_boosted(spark, sf):
    return _against_mean(spark, sf, "boosted")


@query
def fit_horizon(spark, sf):
    """Only inputs known thirty rows ahead."""
    return _against_mean(spark, sf, "boosted", P.HORIZON_FEATURES)


@query
def score_horizon(spark, sf):
    """Only inputs known thirty rows ahead, and the flagship's kind of model."""
    _, test = _matrix_split(spark, sf, P.HORIZON_FEATURES)
    scored = models.score(_fitted(spark, sf, "linear", P.HORIZON_FEATURES), test)
    return rounded(scored.select("Store", "Date", "Sales", "prediction"), "prediction", digits=1)


@query
def coef_importance(spark, sf):
    return rounded(models.importance(spark, _fitted(spark, sf, "linear"), P.SAFE_FEATURES))


@query
def coef_importance_two_inputs(spark, sf):
    names = ["rolling_mean_30", "Promo"]
    train, _ = _matrix_split(spark, sf, names)
    return rounded(models.importance(spark, models.fit("linear", train, names), names), digits=3)


@query
def tree_importance(spark, sf):
    """The stated forest's shares, and those of the small one."""
    weights = models.importance(spark, _fitted(spark, sf, "forest"), P.SAFE_FEATURES)
    total = weights.agg(F.round(F.sum("importance"), 6)).scalar()
    nodes = trees.node_table(spark, _checked(spark, sf, "forest"), P.CHECKED_FEATURES)
    small = trees.node_importance(nodes).withColumnRenamed("importance", "checked_importance")
    both = weights.join(small, "feature", "left").select(
        "feature",
        F.col("importance").between(0, 1).alias("is_share"),
        total.alias("total"),
        F.coalesce("checked_importance", F.lit(0.0)).alias("checked_importance"),
    )
    return rounded(both, "checked_importance", digits=6)


@query
def prediction_table(spark, sf):
    """Least squares on all inputs beside the small ensembles."""
    _, test = _matrix_split(spark, sf)
    fitted = {
        "boosted": _checked(spark, sf, "boosted"),
        "rf": _checked(spark, sf, "forest"),
        "lr": _fitted(spark, sf, "linear"),
    }
    wide = rounded(models.prediction_table(test, fitted), "predicted_sales_lr", digits=1)
    return rounded(wide, *[c for c in wide.columns if "boosted" in c or c.endswith("rf")], digits=2)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Replenishment advice from a trained forecast of inputs known thirty rows ahead."""
    names = P.HORIZON_FEATURES
    matrix = tables.materialize(
        evaluate.model_matrix(gold(spark, sf), [*names, "demand_volatility"]), "matrix"
    )
    train, test = evaluate.time_split(matrix)
    fitted = {"lr": models.fit("linear", train, names)}
    predicted = models.prediction_table(test, fitted, primary="lr", keep=["demand_volatility"])
    latest_rows = inventory.latest_forecast(inventory.roll_forward(predicted, "lr"))
    return inventory.recommend(inventory.optimize(latest_rows), F.lit(AT))


# --- forecast roll-up and inventory ----------------------------------------------------------


@query
def enrich_predictions(spark, sf):
    known = gold_table(spark, sf)
    return rounded(inventory.enrich(with_unknown_stores(forecasts(known)), known))


@query
def enrich_predictions_bucketed(spark, sf):
    """Both sides bucketed by store, joined by store and date without a shuffle of either."""
    known = gold_table(spark, sf)
    buckets = max(4, panel.tasks(spark, sf))  # a task reads one, so their number follows the input's
    layout = {"bucket_by": (buckets, ["Store"]), "sort_by": ["Store", "Date"]}
    strays = with_unknown_stores(forecasts(known))
    _, ahead = saved(strays.repartition(buckets, "Store"), "ahead", **layout)
    _, features = saved(known.repartition(buckets, "Store"), "features", **layout)
    with tables.on_shared_buckets(spark):
        joined = tables.materialize(inventory.enrich(ahead, features), "enriched")
    return rounded(joined)


@query
def forward_sum(spark, sf):
    return _with(
        inventory.forward_sum(panel.store_days(spark, sf), "Sales", "sales_next_30"),
        ["sales_next_30"],
    )


@query
def forward_avg(spark, sf):
    return _with(
        inventory.forward_avg(panel.store_days(spark, sf), "Customers", "customers_next_30"),
        ["customers_next_30"],
    )


@query
def latest_by_store(spark, sf):
    return rounded(latest(spark, sf, rows=1))


@query
def latest_by_store_full_horizon(spark, sf):
    return rounded(latest(spark, sf))


@query
def attach_inventory(spark, sf):
    return rounded(
        inventory.attach_inventory(latest(spark, sf)).select("Store", "current_inventory"), digits=5
    )


def _counted_stock(spark, sf):
    """A stock per store; every fifth one is not known."""
    return panel.store_days(spark, sf).groupBy("Store").agg(
        F.when(F.col("Store") % 5 != 0, F.sum("Customers").cast("double")).alias("current_inventory")
    )


@query
def attach_inventory_table(spark, sf):
    plan = inventory.optimize(latest(spark, sf), _counted_stock(spark, sf))
    return rounded(
        plan.select("Store", "current_inventory", "stockout_risk", "days_until_stockout"), digits=3
    )


@query
def service_z(spark, sf):
    turn = F.col("Store") % 53
    level = (
        F.when(turn < 50, 0.5 + turn / 100)
        .when(turn == 50, 0.001)
        .when(turn == 51, 0.9999)
        .otherwise(1.0)
    )
    return rounded(
        panel.raw_stores(spark, sf).withColumn("service_level", level).select(
            "Store",
            "service_level",
            inventory.z_score(F.col("service_level")).alias("z"),
            inventory.z_score(0.95).alias("z_95"),
        ),
        "z",
        "z_95",
        digits=6,
    )


def _per_store_demand(spark, sf):
    return panel.store_days(spark, sf).groupBy("Store").agg(
        F.avg("Sales").alias("daily"), F.stddev_samp("Sales").alias("sigma")
    )


@query
def safety_stock(spark, sf):
    stock = inventory.safety_stock(F.col("sigma"), inventory.z_score(0.95), 7)
    return rounded(_per_store_demand(spark, sf).select("Store", stock.alias("safety_stock")), digits=3)


@query
def reorder_point(spark, sf):
    stock = inventory.safety_stock(F.col("sigma"), inventory.z_score(0.95), 7)
    point = inventory.reorder_point(F.col("daily"), stock, 7)
    return rounded(_per_store_demand(spark, sf).select("Store", point.alias("reorder_point")), digits=3)


@query
def eoq(spark, sf):
    demand = F.when(F.col("daily") > 7400, F.col("daily") * 365).otherwise(0.0)
    lot = inventory.economic_order_quantity(demand, 100, 30)
    return rounded(_per_store_demand(spark, sf).select("Store", lot.alias("economic_order_qty")))


@query
def optimal_inventory(spark, sf):
    chosen = inventory.optimal_inventory(
        inventory.attach_inventory(latest(spark, sf)),
        service_level=0.90 + (F.col("Store") % 9) / 100.0,
        lead_time_days=1 + F.col("Store") % 14,
    )
    return rounded(
        chosen.select(
            "Store", "safety_stock", "reorder_point", "stockout_risk", "service_level"
        ),
        digits=2,
    )


@query
def optimal_inventory_unknown(spark, sf):
    """Stores without a forecast or without a stock: unknown, not healthy."""
    no_frame = F.col("Store") % 7 == 0
    known = latest(spark, sf)
    partly = known.withColumns(
        {
            c: F.when(~no_frame, F.col(c))
            for c in ("latest_date", "forecast_next_30d", "demand_volatility_30d")
        }
    )
    plan = inventory.optimize(partly, _counted_stock(spark, sf))
    advice = inventory.graded_priority(inventory.recommend(plan, F.lit(AT)))
    return rounded(timeless(advice), digits=3)


@query
def optimize_stores(spark, sf):
    return rounded(stock_plan(spark, sf), digits=5)


@query
def recommend_action(spark, sf):
    return inventory.recommend_action(stock_plan(spark, sf)).select("Store", "recommended_action")


@query
def order_priority(spark, sf):
    return inventory.order_priority(stock_plan(spark, sf)).select("Store", "order_priority")


@query
def graded_priority(spark, sf):
    return inventory.graded_priority(stock_plan(spark, sf)).select("Store", "graded_priority")


@query
def inventory_gap(spark, sf):
    return rounded(
        inventory.inventory_gap(stock_plan(spark, sf)).select(
            "Store", "inventory_gap", "excess_inventory"
        ),
        digits=5,
    )


@query
def recommend(spark, sf):
    return rounded(timeless(recommendations(spark, sf)), digits=5)


@query
def impact_totals(spark, sf):
    return rounded(inventory.impact_totals(recommendations(spark, sf)), digits=5)


@query
def business_impact(spark, sf):
    return rounded(timeless(inventory.business_impact(recommendations(spark, sf))), digits=5)


@query
def urgent_topk(spark, sf):
    return inventory.urgent(exact_recommendations(spark, sf))


# --- reports ---------------------------------------------------------------------------------


@query
def kpi_summary(spark, sf):
    return rounded(reports.kpi_summary(predictions(spark, sf), FORECAST).drop("report_date"))


def _rollup(spark, sf):
    """Stored sums of two batches of predictions, of which one was first sent incomplete."""
    rows = predictions(spark, sf)
    late = F.dayofmonth("Date") % 3 == 0
    name, path = scratch("rollup"), tables.shared_folder(spark, "rollup")
    for batch, part in (
        ("first", rows.filter(~late & (F.col("Store") % 2 == 0))),
        ("second", rows.filter(late)),
        ("first", rows.filter(~late)),
    ):
        stored = tables.append_batch(
            rollups.partials(part, FORECAST).withColumn("batch", F.lit(batch)), name, "batch", path=path
        )
    return stored


@query
def kpi_summary_merged(spark, sf):
    return rounded(rollups.kpi_summary(_rollup(spark, sf)).drop("report_date"))


@query
def accuracy_by_type_merged(spark, sf):
    return rounded(rollups.accuracy_by_type(_rollup(spark, sf), silver_stores(spark, sf)))


@query
def weekly_trend_merged(spark, sf):
    return rounded(rollups.weekly_trend(rollups.merge(_rollup(spark, sf))))


@query
def kpi_cards(spark, sf):
    return reports.kpi_cards(reports.kpi_summary(predictions(spark, sf), FORECAST))


@query
def top_accurate(spark, sf):
    return rounded(reports.top_accurate(predictions(spark, sf), FORECAST))


@query
def accuracy_by_type(spark, sf):
    return rounded(reports.accuracy_by_type(predictions(spark, sf), silver_stores(spark, sf), FORECAST))


@query
def stockout_alerts(spark, sf):
    return reports.stockout_alerts(exact_recommendations(spark, sf))


@query
def savings_by_store(spark, sf):
    return reports.savings_by_store(exact_recommendations(spark, sf))


@query
def savings_total(spark, sf):
    return rounded(reports.savings_total(exact_recommendations(spark, sf)), digits=2)


@query
def weekly_trend(spark, sf):
    return rounded(reports.weekly_trend(predictions(spark, sf), FORECAST))


@query
def importance_rank(spark, sf):
    strength = analysis.top_correlations(
        gold(spark, sf), "Sales", P.CORRELATED_FEATURES, len(P.CORRELATED_FEATURES)
    ).select("feature", F.round("correlation_with_sales", 4).alias("importance"))
    return rounded(reports.importance_rank(strength))


@query
def promo_analysis(spark, sf):
    carried = forecasts(gold_table(spark, sf), "Promo", "sales_per_customer")
    return rounded(reports.promo_analysis(carried, FORECAST))


@query
def competition_impact(spark, sf):
    return rounded(
        reports.competition_impact(predictions(spark, sf), silver_stores(spark, sf), FORECAST)
    )


@query
def impact_latest(spark, sf):
    impact = rounded(inventory.business_impact(recommendations(spark, sf)))
    older = impact.withColumn("analysis_date", F.lit(AT)).withColumn("total_stores", F.lit(0))
    _, history = saved(impact.unionByName(older), "impact")
    return timeless(reports.impact_latest(history))
