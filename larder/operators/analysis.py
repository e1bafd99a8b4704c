"""Feature analysis: correlations, repeatable samples and histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.operators import moments


def top_correlations(df: DataFrame, target: str, columns: Sequence[str], k: int = 5) -> DataFrame:
    """The k columns with the highest Pearson correlation with the target."""
    name = f"correlation_with_{target.lower()}"
    pairs = moments.co_moments(df, [*columns, target]).filter(F.col("b") == len(columns))
    rows = pairs.filter("a <> b").select("a", moments.correlation().alias(name))
    named = _local(df, [(i, c) for i, c in enumerate(columns)], "a int, feature string")
    return (
        named.join(F.broadcast(rows), "a", "left")
        .select("feature", name)
        .orderBy(F.desc_nulls_last(name), "feature")
        .limit(k)
    )


def _local(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """A table as small as a list of columns."""
    return df.sparkSession.createDataFrame(rows, schema).coalesce(1)


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every two of the listed columns, and of each with itself.

    A pair skips rows where either value is NULL. The correlation of a column with itself is 1;
    it is NULL where a column does not vary or a pair has no rows in common.
    """
    upper = moments.co_moments(df, columns).select("a", "b", moments.correlation().alias("correlation"))
    names = [
        (min(i, j), max(i, j), one, two)
        for i, one in enumerate(columns)
        for j, two in enumerate(columns)
    ]
    pairs = _local(df, names, "a int, b int, feature_a string, feature_b string")
    return pairs.join(F.broadcast(upper), ["a", "b"], "left").select(
        "feature_a", "feature_b", "correlation"
    )


def key_digest(keys: Sequence[str]) -> Column:
    """A hash of the key that other SQL engines compute alike."""
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]))


def sample_rows(df: DataFrame, keys: Sequence[str], fraction: float) -> DataFrame:
    """About ``fraction`` of the rows, chosen by key, so that the choice never changes."""
    if fraction >= 1:
        return df
    cut = format(int(fraction * 16**8), "08x")
    return df.filter(key_digest(keys) < F.lit(cut))


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """Rows per equally wide bin between the least and the greatest value, empty bins included."""
    value = F.col(column).cast("double")
    extent = df.agg(F.min(value).alias("low"), F.max(value).alias("high"))
    limits = extent.select(F.struct("low", "high")).scalar()
    share = F.try_divide((value - limits["low"]) * bins, limits["high"] - limits["low"])
    number = F.least(F.floor(F.coalesce(share, F.lit(0.0))), F.lit(bins - 1)).cast("int")
    counts = (
        df.filter(value.isNotNull())
        .groupBy(number.alias("bin"))
        .agg(F.count("*").alias("row_count"))
    )
    width = (F.col("high") - F.col("low")) / bins
    grid = extent.select(
        "low", width.alias("width"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    )
    return grid.join(counts, "bin", "left").select(
        "bin",
        (F.col("low") + F.col("bin") * F.col("width")).alias("lower_edge"),
        (F.col("low") + (F.col("bin") + 1) * F.col("width")).alias("upper_edge"),
        F.coalesce("row_count", F.lit(0)).alias("row_count"),
    )
