"""Silver layer: cleaning rules for sales and stores.

Predicates follow SQL's three-valued logic: a row whose rule evaluates to NULL is dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.columns import first_below, flag, lookup, to_rows
from larder.operators.quantile import flag_above_quantile
from larder.params import (
    COMPETITION_FILL,
    CRITICAL_SALES_COLUMNS,
    DATE_FORMAT,
    HOLIDAY_CODES,
    NO_COMPETITION,
    OUTLIER_QUANTILE,
    PROMO2_FILL,
    PROXIMITY_BELOW,
    RULES_VERSION,
    SALES_KEY,
    SALES_TYPES,
)


def standardize_date(df: DataFrame, column: str = "Date", fmt: str = DATE_FORMAT) -> DataFrame:
    """Text to date; text that is no date becomes NULL."""
    kind = dict(df.dtypes)[column]
    if kind == "date":
        return df
    if kind.startswith("timestamp"):
        return df.withColumn(column, F.col(column).cast("date"))
    return df.withColumn(column, F.try_to_date(F.col(column).cast("string"), fmt))


def standardize_types(df: DataFrame, types: Mapping[str, str] = SALES_TYPES) -> DataFrame:
    """Cast the listed columns; values that do not convert become NULL."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items()})


def keep_open_or_unsold() -> Column:
    return ~((F.col("Open") == 0) & (F.col("Sales") > 0))


def keep_non_negative() -> Column:
    return F.col("Sales") >= 0


def keep_complete(columns: Sequence[str] = CRITICAL_SALES_COLUMNS) -> Column:
    complete = F.lit(True)
    for c in columns:
        complete = complete & F.col(c).isNotNull()
    return complete


SALES_RULES = {
    "closed_with_sales": keep_open_or_unsold,
    "negative_sales": keep_non_negative,
    "null_critical": keep_complete,
}


def drop_closed_sales(df: DataFrame) -> DataFrame:
    return df.filter(keep_open_or_unsold())


def drop_negative_sales(df: DataFrame) -> DataFrame:
    """Keep sales of zero and more; this drops NULL sales as well."""
    return df.filter(keep_non_negative())


def drop_null_critical(df: DataFrame, columns: Sequence[str] = CRITICAL_SALES_COLUMNS) -> DataFrame:
    return df.dropna(subset=list(columns))


def dedupe(
    df: DataFrame, keys: Sequence[str] = SALES_KEY, order: Sequence[str | Column] | None = None
) -> DataFrame:
    """One row per key: the first in ``order``, by default the newest and fullest.

    That is the last load by ``ingestion_timestamp``, then the row with the fewest NULLs, then
    the least ``row_hash``, as far as there are such columns, and last the order of all others.
    Keeping row number 1 lets Spark cut every key down to one row per map task before the
    shuffle, so the copies of a key never meet in a single task.
    """
    if order is None:
        others = [c for c in df.columns if c not in keys]
        gaps = sum((F.col(c).isNull().cast("int") for c in others), F.lit(0))
        newest = [F.col(c).desc_nulls_last() for c in others if c == "ingestion_timestamp"]
        order = [*newest, gaps, *[c for c in others if c == "row_hash"], *others] if others else []
    if not order:
        return df.dropDuplicates(list(keys))
    position = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_position", position).filter("_position = 1").drop("_position")


def decode(df: DataFrame, column: str, codes: Mapping[str, str] = HOLIDAY_CODES) -> DataFrame:
    """Replace known codes by their meaning and leave other values as they are."""
    return df.withColumn(column, lookup(F.col(column), codes, otherwise=F.col(column)))


def business_flags(df: DataFrame) -> DataFrame:
    """Holiday, promotion, open and customer flags on decoded sales."""
    return df.withColumns(
        {
            "is_holiday": flag((F.col("StateHoliday") != "None") | (F.col("SchoolHoliday") == 1)),
            "is_promo_day": F.col("Promo"),
            "is_open": F.col("Open"),
            "has_customers": flag(F.col("Customers") > 0),
        }
    )


def stamp(
    df: DataFrame,
    processed_at: datetime | None = None,
    layer: str = "silver",
    status: str = "cleaned",
    version: str = RULES_VERSION,
) -> DataFrame:
    """Processing metadata; the time defaults to the start of the query."""
    time = F.current_timestamp() if processed_at is None else F.lit(processed_at)
    return df.withColumns(
        {
            "processing_timestamp": time.cast("timestamp"),
            "data_quality_layer": F.lit(layer),
            "data_quality_status": F.lit(status),
            "cleaning_rules_version": F.lit(version),
        }
    )


def standardize_sales(df: DataFrame) -> DataFrame:
    """Dates, numbers and text codes in their proper types, before any rule compares them."""
    return standardize_types(standardize_date(df)).withColumn(
        "StateHoliday", F.col("StateHoliday").cast("string")
    )


def apply_sales_rules(df: DataFrame) -> DataFrame:
    """Standardise, drop faulty rows and repeated keys, decode and flag: all but the outliers."""
    rows = drop_null_critical(drop_negative_sales(drop_closed_sales(standardize_sales(df))))
    return business_flags(decode(dedupe(rows), "StateHoliday"))


def clean_sales(
    df: DataFrame,
    processed_at: datetime | None = None,
    exact_outliers: bool = True,
    stage: Callable[[DataFrame], DataFrame] = lambda rows: rows,
) -> DataFrame:
    """All sales rules in order.

    The outlier threshold is a quantile of the cleaned rows. ``stage`` may write those rows and
    read them back (``larder.sources.tables.materialize`` does): the passes that find the
    quantile then read one column of a table instead of cleaning everything again.
    """
    rows = stage(apply_sales_rules(df))
    flagged = flag_above_quantile(rows, "Sales", OUTLIER_QUANTILE, exact=exact_outliers)
    return stamp(flagged, processed_at)


def audit_rules(df: DataFrame, keys: Sequence[str] = SALES_KEY) -> DataFrame:
    """Rows before, after and removed by each sales rule, in one pass.

    Each row is tagged with the first rule it breaks. Rows that break none are counted per key,
    and those beyond the first of a key are the repeated ones.
    """
    broken = [
        F.when(~F.coalesce(rule(), F.lit(False)), F.lit(name))
        for name, rule in SALES_RULES.items()
    ]
    tagged = standardize_sales(df).withColumn("rule", F.coalesce(*broken))
    kept = F.col("rule").isNull()
    per_key = tagged.groupBy("rule", *[F.when(kept, F.col(k)).alias(k) for k in keys]).agg(
        F.count("*").alias("rows")
    )
    totals = per_key.agg(
        *[
            F.sum(F.when(F.col("rule") == name, F.col("rows")).otherwise(0)).alias(name)
            for name in SALES_RULES
        ],
        F.sum(F.when(kept, F.col("rows") - 1).otherwise(0)).alias("duplicate_key"),
        F.sum("rows").alias("total"),
    )
    steps = [*SALES_RULES, "duplicate_key"]
    out = []
    before = F.col("total")
    for i, name in enumerate(steps, start=1):
        after = before - F.col(name)
        out.append(
            {
                "step": F.lit(i),
                "rule": F.lit(name),
                "rows_before": before,
                "rows_after": after,
                "rows_removed": F.col(name),
                "retention_pct": F.try_divide(after * 100.0, F.col("total")),
            }
        )
        before = after
    return to_rows(totals, out)


def drop_null_store(df: DataFrame) -> DataFrame:
    return df.filter(F.col("Store").isNotNull())


def normalize_categories(
    df: DataFrame, columns: Sequence[str] = ("StoreType", "Assortment")
) -> DataFrame:
    return df.withColumns({c: F.upper(F.trim(c)) for c in columns})


def fill_competition(df: DataFrame) -> DataFrame:
    """A far-away sentinel where no competitor is known."""
    return df.fillna(COMPETITION_FILL)


def fill_promo2(df: DataFrame) -> DataFrame:
    return df.fillna(PROMO2_FILL)


def store_derived(df: DataFrame) -> DataFrame:
    distance = F.col("CompetitionDistance")
    return df.withColumns(
        {
            "has_competition": flag(distance < NO_COMPETITION),
            "in_promo2": flag(F.col("Promo2") == 1),
            "competition_distance_km": F.when(distance < NO_COMPETITION, distance / 1000),
            "store_category": F.concat("StoreType", F.lit("-"), "Assortment"),
        }
    )


def competition_bucket(df: DataFrame) -> DataFrame:
    near = first_below(F.col("CompetitionDistance"), PROXIMITY_BELOW, otherwise="None")
    return df.withColumn("competition_proximity", near)


def clean_stores(df: DataFrame, processed_at: datetime | None = None) -> DataFrame:
    """All store rules in order: one row per store, from the last load that has it."""
    steps = (
        drop_null_store,
        lambda rows: dedupe(rows, ["Store"]),
        normalize_categories,
        fill_competition,
        fill_promo2,
        store_derived,
        competition_bucket,
    )
    for step in steps:
        df = df.transform(step)
    return stamp(df, processed_at)
