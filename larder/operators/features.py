"""Gold layer: features of a store-day panel.

A panel has one row per (Store, Date), so a store holds at most as many rows as the calendar has
days, and windows partitioned by Store stay small however large the panel grows. All ordered
windows share one partitioning and one ordering, which Spark serves with one shuffle and one sort.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from larder.functions.columns import (
    first_above,
    first_below,
    flag,
    guarded_ratio,
    keep_compiled,
    lookup,
    to_rows,
)
from larder.params import (
    ASSORTMENT_SCORES,
    CATEGORICAL_FEATURES,
    CUSTOMER_LAGS,
    CYCLES,
    FEATURE_CATEGORIES,
    FEATURE_VERSION,
    GROWTH_LAGS,
    MEAN_WINDOWS,
    PRESSURE_BELOW,
    SALES_LAGS,
    STD_WINDOWS,
    STOCKOUT_CUSTOMERS_ABOVE,
    STOCKOUT_SALES_BELOW,
    STORE_TYPE_SCORES,
    TIER_ABOVE,
    TREND_DOWN,
    TREND_UP,
    WARMUP_COLUMNS,
)


def by_store() -> WindowSpec:
    return Window.partitionBy("Store").orderBy("Date")


def by_store_day_number() -> WindowSpec:
    return Window.partitionBy("Store").orderBy(F.unix_date("Date"))


def preceding(k: int, calendar: bool = False) -> WindowSpec:
    """The k rows, or with ``calendar`` the k days, before the current one."""
    return by_store_day_number().rangeBetween(-k, -1) if calendar else by_store().rowsBetween(-k, -1)


def join_dim(
    fact: DataFrame, dimension: DataFrame, key: str = "Store", prefix: str = "store_"
) -> DataFrame:
    """Left join with a dimension; its columns that clash with the fact's get a prefix.

    Carries no broadcast hint: Spark broadcasts a dimension below
    ``spark.sql.autoBroadcastJoinThreshold`` and otherwise joins on the partitioning by ``key``
    that the window features already need.
    """
    clashes = set(fact.columns) & set(dimension.columns) - {key}
    renamed = dimension.withColumnsRenamed({c: prefix + c for c in clashes})
    return fact.join(renamed, key, "left")


def add_calendar(df: DataFrame, date: str = "Date") -> DataFrame:
    """Twelve calendar columns."""
    d = F.col(date)
    month, day, weekday = F.month(d), F.dayofmonth(d), F.dayofweek(d)
    northern = {"Spring": (3, 5), "Summer": (6, 8), "Fall": (9, 11)}
    in_season = {name: month.between(*months) for name, months in northern.items()}
    season = F.coalesce(*[F.when(c, name) for name, c in in_season.items()], F.lit("Winter"))
    number = F.coalesce(*[F.when(c, i) for i, c in enumerate(in_season.values(), 1)], F.lit(4))
    return df.withColumns(
        {
            "year": F.year(d),
            "month": month,
            "day": day,
            "day_of_week": weekday,
            "week_of_year": F.weekofyear(d),
            "quarter": F.quarter(d),
            "is_weekend": flag(weekday.isin(1, 7)),
            "is_month_start": flag(day <= 7),
            "is_month_end": flag(day >= 25),
            "days_in_month": F.dayofmonth(F.last_day(d)),
            "season": season,
            "season_num": number,
        }
    )


def add_lags(
    df: DataFrame, column: str, lags: Sequence[int], calendar: bool = False
) -> DataFrame:
    """Value k rows, or with ``calendar`` exactly k days, earlier in the store's history."""

    def lagged(k: int) -> Column:
        if calendar:
            return F.max(column).over(by_store_day_number().rangeBetween(-k, -k))
        return F.lag(column, k).over(by_store())

    return df.withColumns({f"{column.lower()}_lag_{k}": lagged(k) for k in lags})


WINDOW_STATS = {
    "mean": lambda c, w: F.avg(c).over(w),
    "std": lambda c, w: F.stddev_samp(c).over(w),
    "min": lambda c, w: F.min(c).over(w),
    "max": lambda c, w: F.max(c).over(w),
    # The lower median, of a frame's values in order: a sketch per row costs more than its sort.
    "median": lambda c, w: F.get(
        F.sort_array(F.collect_list(c).over(w)), F.floor((F.count(c).over(w) - 1) / 2).cast("int")
    ),
}


def add_rolling(
    df: DataFrame,
    column: str,
    stat: str,
    windows: Sequence[int],
    name: str = "rolling_{stat}_{k}",
    calendar: bool = False,
) -> DataFrame:
    """A statistic of the k preceding rows (or days); the current row is left out."""
    of = WINDOW_STATS[stat]
    return df.withColumns(
        {name.format(stat=stat, k=k): of(column, preceding(k, calendar)) for k in windows}
    )


def _shared_frame(k: int, windows: Sequence[int]) -> int:
    """The shortest of the windows that fits two or three times into ``k``, or ``k`` itself."""
    return min((j for j in windows if k in (2 * j, 3 * j)), default=k)


def add_rolling_moments(
    df: DataFrame,
    column: str,
    means: Sequence[int],
    stds: Sequence[int],
    name: str = "rolling_{stat}_{k}",
) -> DataFrame:
    """Means and standard deviations of the k preceding rows.

    Gives what ``add_rolling`` gives, with less work: Spark evaluates a sliding frame afresh for
    every row, so a frame of 90 costs 90 steps per row. A frame that is two or three times as
    long as another is merged here from that frame's count, sum and squared deviations, taken at
    the current row and at rows one and two frame lengths earlier.
    """
    windows = sorted({*means, *stds})
    source = {k: _shared_frame(k, windows) for k in windows}
    frames = sorted(set(source.values()))
    base = {}
    for j in frames:
        w = preceding(j)
        base[f"_n_{j}"] = F.count(column).over(w)
        base[f"_sum_{j}"] = F.sum(column).over(w)
        base[f"_dev_{j}"] = F.var_pop(column).over(w) * F.count(column).over(w)
    earlier = {
        f"{part}_{j}_{i}": F.lag(f"{part}_{j}", i * j).over(by_store())
        for k, j in source.items()
        for i in range(1, k // j)
        for part in ("_n", "_sum", "_dev")
    }

    def parts(kind: str, k: int) -> list[Column]:
        j = source[k]
        names = [f"{kind}_{j}", *[f"{kind}_{j}_{i}" for i in range(1, k // j)]]
        return [F.coalesce(n, F.lit(0)) for n in names]

    def add(columns: Sequence[Column]) -> Column:
        return reduce(lambda a, b: a + b, columns)

    def mean(k: int) -> Column:
        return F.when(F.col(f"_rows_{k}") > 0, add(parts("_sum", k)) / F.col(f"_rows_{k}"))

    def std(k: int) -> Column:
        squares = parts("_dev", k)
        if k != source[k]:
            for n, part in zip(parts("_n", k), parts("_sum", k)):
                gap = part / n - F.col(f"_mean_{k}")
                squares.append(F.when(n > 0, n * gap * gap).otherwise(0.0))
        freedom = F.col(f"_rows_{k}") - 1
        return F.when(freedom > 0, F.sqrt(add(squares) / freedom))

    rows = {f"_rows_{k}": add(parts("_n", k)) for k in windows}
    centres = {f"_mean_{k}": mean(k) for k in windows}
    named = {name.format(stat="mean", k=k): F.col(f"_mean_{k}") for k in means}
    named |= {name.format(stat="std", k=k): std(k) for k in stds}
    for step in (base, earlier, rows, centres, named):
        df = df.withColumns(step)
    return df.drop(*base, *earlier, *rows, *centres)


def add_rolling_features(df: DataFrame, calendar: bool = False) -> DataFrame:
    """The twelve rolling features and the promotion share, all on one partitioning."""
    if calendar:
        df = add_rolling(df, "Sales", "mean", MEAN_WINDOWS, calendar=True)
        df = add_rolling(df, "Sales", "std", STD_WINDOWS, calendar=True)
    else:
        df = add_rolling_moments(df, "Sales", MEAN_WINDOWS, STD_WINDOWS)
    # The frame's values in order hold the least, the greatest and the middle one.
    held = F.sort_array(F.collect_list("Sales").over(preceding(30, calendar)))
    df = df.withColumn("_in_order", held)
    last = F.size("_in_order") - 1
    at = {"min": F.lit(0), "max": last, "median": F.floor(last / 2).cast("int")}
    df = df.withColumns({f"rolling_{stat}_30": F.get("_in_order", i) for stat, i in at.items()})
    df = df.drop("_in_order")
    steps = [
        ("Customers", "mean", "rolling_customers_{stat}_{k}"),
        ("Promo", "mean", "promo_frequency_{k}d"),
    ]
    for column, stat, name in steps:
        df = add_rolling(df, column, stat, [30], name, calendar)
    return df


def add_growth(df: DataFrame, column: str, lags: Sequence[int]) -> DataFrame:
    """Percentage change against the lagged value; 0 where that is missing or not positive."""

    def change(k: int) -> Column:
        earlier = F.col(f"{column.lower()}_lag_{k}")
        return F.when(earlier > 0, (F.col(column) - earlier) / earlier * 100).otherwise(0.0)

    return df.withColumns({f"{column.lower()}_growth_{k}d": change(k) for k in lags})


def add_volatility(df: DataFrame) -> DataFrame:
    ratio = guarded_ratio(F.col("rolling_std_30"), F.col("rolling_mean_30"), 0.0)
    return df.withColumn("demand_volatility", ratio)


def add_momentum(df: DataFrame, up: float = TREND_UP, down: float = TREND_DOWN) -> DataFrame:
    """Short over long mean, and the direction it points to."""
    short, long = F.col("rolling_mean_7"), F.col("rolling_mean_30")
    momentum = F.when((short > 0) & (long > 0), short / long).otherwise(1.0)
    direction = (
        F.when(F.col("sales_momentum") > up, "Increasing")
        .when(F.col("sales_momentum") < down, "Decreasing")
        .otherwise("Stable")
    )
    return df.withColumn("sales_momentum", momentum).withColumn("trend_direction", direction)


def add_cyclic(df: DataFrame, cycles: Mapping[str, int] = CYCLES) -> DataFrame:
    """Sine and cosine of each column's position in its cycle."""
    waves = {}
    for column, period in cycles.items():
        angle = F.col(column) * (2 * math.pi / period)
        waves[f"{column}_sin"] = F.sin(angle)
        waves[f"{column}_cos"] = F.cos(angle)
    return df.withColumns(waves)


def add_competition_pressure(df: DataFrame) -> DataFrame:
    pressure = first_below(F.col("CompetitionDistance"), PRESSURE_BELOW, otherwise=0)
    return df.withColumn("competition_pressure", pressure)


def add_store_average(df: DataFrame) -> DataFrame:
    """Mean sales over the store's whole history, later days included."""
    return df.withColumn("avg_sales_per_store", F.avg("Sales").over(Window.partitionBy("Store")))


def add_tier(df: DataFrame) -> DataFrame:
    tier = first_above(F.col("avg_sales_per_store"), TIER_ABOVE, otherwise="Low")
    return df.withColumn("store_performance_tier", tier)


def add_sales_per_customer(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "sales_per_customer", guarded_ratio(F.col("Sales"), F.col("Customers"), 0.0)
    )


def add_promo_effect(df: DataFrame) -> DataFrame:
    """Whether a promotion day beat the mean before it; no mean counts as no promotion."""
    promo, usual = F.col("Promo") == 1, F.col("rolling_mean_30")
    return df.withColumn(
        "promo_effectiveness",
        F.when(promo & (F.col("Sales") > usual), "Effective")
        .when(promo & (F.col("Sales") <= usual), "Ineffective")
        .otherwise("No Promo"),
    )


def add_potential_stockout(
    df: DataFrame,
    sales_below: float = STOCKOUT_SALES_BELOW,
    customers_above: int = STOCKOUT_CUSTOMERS_ABOVE,
) -> DataFrame:
    """Open with many customers and hardly any sales."""
    starved = (F.col("Sales") < sales_below) & (F.col("Customers") > customers_above)
    return df.withColumn("potential_stockout", flag((F.col("Open") == 1) & starved))


def add_holiday_multiplier(df: DataFrame) -> DataFrame:
    usual = F.col("rolling_mean_30")
    on_holiday = (F.col("is_holiday") == 1) & (usual > 0)
    return df.withColumn(
        "holiday_sales_multiplier", F.when(on_holiday, F.col("Sales") / usual).otherwise(1.0)
    )


def encode(
    df: DataFrame, column: str, scores: Mapping[str, int], name: str, default: int = 1
) -> DataFrame:
    return df.withColumn(name, lookup(F.col(column), scores, otherwise=default))


def add_store_scores(df: DataFrame) -> DataFrame:
    scored = encode(df, "Assortment", ASSORTMENT_SCORES, "assortment_score")
    return encode(scored, "StoreType", STORE_TYPE_SCORES, "store_type_score")


def add_domain(df: DataFrame) -> DataFrame:
    """Features that need no further window once the rolling ones exist."""
    steps = (
        add_competition_pressure,
        add_tier,
        add_sales_per_customer,
        add_promo_effect,
        add_potential_stockout,
        add_holiday_multiplier,
        add_store_scores,
    )
    for step in steps:
        df = df.transform(step)
    return df


def drop_warmup(df: DataFrame, columns: Sequence[str] = WARMUP_COLUMNS) -> DataFrame:
    """Drop the first rows of each store, whose history is too short."""
    return df.dropna(subset=list(columns))


def warmup_retention(df: DataFrame, columns: Sequence[str] = WARMUP_COLUMNS) -> DataFrame:
    """Rows before and after ``drop_warmup``, counted in one pass."""
    complete = F.lit(True)
    for c in columns:
        complete = complete & F.col(c).isNotNull()
    counts = df.agg(F.count("*").alias("rows_before"), F.count_if(complete).alias("rows_after"))
    return counts.withColumns(
        {
            "rows_removed": F.col("rows_before") - F.col("rows_after"),
            "retention_pct": F.try_divide(F.col("rows_after") * 100.0, F.col("rows_before")),
        }
    )


def stamp_features(df: DataFrame, built_at: datetime | None = None) -> DataFrame:
    """Feature metadata; the count is that of the registered features present."""
    registered = {f for features in FEATURE_CATEGORIES.values() for f in features}
    time = F.current_timestamp() if built_at is None else F.lit(built_at)
    return df.withColumns(
        {
            "feature_engineering_timestamp": time.cast("timestamp"),
            "feature_version": F.lit(FEATURE_VERSION),
            "total_features": F.lit(len(registered & set(df.columns))),
        }
    )


def build_features(
    sales: DataFrame,
    stores: DataFrame,
    built_at: datetime | None = None,
    calendar: bool = False,
) -> DataFrame:
    """All features of cleaned sales and stores, without the warm-up rows.

    Windows come first, over the sales columns alone: the shuffle by Store then carries no store
    attribute, and a store table too large to broadcast is joined on that same partitioning.
    Projections are spread between the windows because Spark generates one method for all that
    lies between two of them, and the JVM leaves methods over 8,000 bytes interpreted.
    """
    keep_compiled(sales.sparkSession)
    panel = add_lags(sales, "Sales", SALES_LAGS, calendar)
    panel = add_lags(panel, "Customers", CUSTOMER_LAGS, calendar)
    panel = add_calendar(add_growth(panel, "Sales", GROWTH_LAGS))
    panel = add_store_average(add_rolling_features(panel, calendar))
    panel = join_dim(drop_warmup(panel), stores)
    panel = add_cyclic(add_momentum(add_volatility(panel)))
    return stamp_features(add_domain(panel), built_at)


def feature_coverage(df: DataFrame) -> DataFrame:
    """The dictionary of the features ``df`` holds, with how many of its rows fill each."""
    kinds = {
        name: (category, "Categorical" if name in CATEGORICAL_FEATURES else "Numeric")
        for category, features in FEATURE_CATEGORIES.items()
        for name in features
        if name in df.columns
    }
    return to_rows(
        df.agg(*[F.count(name).alias(name) for name in kinds]),
        [
            {
                "feature_name": F.lit(name),
                "category": F.lit(category),
                "data_type": F.lit(kind),
                "filled_rows": F.col(name),
            }
            for name, (category, kind) in kinds.items()
        ],
    )


def feature_counts(dictionary: DataFrame) -> DataFrame:
    """Features per category of a dictionary."""
    return dictionary.groupBy("category").agg(F.count("*").alias("features"))
