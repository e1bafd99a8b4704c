"""Co-moments of columns: one fixed-size table that correlations and linear models come from.

Moments of parts add up to those of the whole, so they can be stored per load and merged later
without reading the rows again.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ("n", "mean_a", "mean_b", "moment_a", "moment_b", "moment_ab")
SCHEMA = "a int, b int, n double, mean_a double, mean_b double, moment_a double, moment_b double, moment_ab double"
ROWS = 1 << 14  # rows multiplied at a time


def _task(width: int):
    """For rows of ``width`` doubles: a row per pair of columns with the pair's moments.

    A task adds up four square matrices whatever the number of its rows: how many rows have both
    values, and sums of values, squares and products over those rows. Values are taken from the
    means of the task's first rows, so that large means cost no digits.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q, p, odd = (np.zeros((width, width)) for _ in range(5))
        shift = None
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                block = batch.slice(at, ROWS)
                there = np.column_stack(
                    [c.is_valid().to_numpy(zero_copy_only=False) for c in block.columns]
                )
                x = np.column_stack(
                    [c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in block.columns]
                )
                finite = np.isfinite(x)
                usable = there & finite
                if shift is None:
                    count = usable.sum(axis=0)
                    shift = np.where(usable, x, 0.0).sum(axis=0) / np.maximum(count, 1)
                z = np.where(usable, x - shift, 0.0) if usable.all() else np.where(
                    usable, np.where(finite, x, 0.0) - shift, 0.0
                )
                m = there.astype(float)
                n += m.T @ m
                s += z.T @ m
                q += (z * z).T @ m
                p += z.T @ z
                odd += (there & ~finite).T.astype(float) @ m
        if shift is None:
            return
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = s / n  # of the row's column where the column's column has a value too
            own = np.where((odd > 0) | (odd.T > 0), np.nan, q - s * mean)
            both = np.where((odd > 0) | (odd.T > 0), np.nan, p - s * mean.T)
        a, b = np.triu_indices(width)
        seen = n[a, b] > 0
        a, b = a[seen], b[seen]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(n[a, b]),
                pa.array(mean[a, b] + shift[a]), pa.array(mean[b, a] + shift[b]),
                pa.array(own[a, b]), pa.array(own[b, a]), pa.array(both[a, b]),
            ],
            ["a", "b", *FIELDS],
        )

    return run


def _merged(parts: Column) -> Column:
    """The moments of a list of disjoint parts."""

    def add(one: Column, two: Column) -> Column:
        n = one["n"] + two["n"]
        share = two["n"] / n
        step_a, step_b = two["mean_a"] - one["mean_a"], two["mean_b"] - one["mean_b"]
        weight = one["n"] * share
        return F.struct(
            n.alias("n"),
            (one["mean_a"] + step_a * share).alias("mean_a"),
            (one["mean_b"] + step_b * share).alias("mean_b"),
            (one["moment_a"] + two["moment_a"] + step_a * step_a * weight).alias("moment_a"),
            (one["moment_b"] + two["moment_b"] + step_b * step_b * weight).alias("moment_b"),
            (one["moment_ab"] + two["moment_ab"] + step_a * step_b * weight).alias("moment_ab"),
        )

    nothing = F.struct(*[F.lit(0.0).alias(f) for f in FIELDS])
    return F.aggregate(F.array_sort(parts), nothing, add)


def merge(moments: DataFrame) -> DataFrame:
    """One row per pair of columns from the moments of disjoint parts, such as tasks or loads.

    A pair's group has a row per part, never per row of data.
    """
    parts = F.collect_list(F.struct(*FIELDS))
    return moments.groupBy("a", "b").agg(_merged(parts).alias("m")).select("a", "b", "m.*")


def co_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, means, variances and covariance, times the count, of every two columns.

    ``a`` and ``b`` are the columns' positions, ``a`` <= ``b``; a pair counts the rows in which
    neither is NULL, and is absent if there are none. NaN or infinite values make a pair's moments
    NaN. One scan: every task multiplies its rows into one matrix and sends that.
    """
    doubles = df.select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)])
    return merge(doubles.mapInArrow(_task(len(columns)), SCHEMA))


def correlation() -> Column:
    """The correlation of a row of moments; NULL where a column does not vary."""
    spread = F.sqrt("moment_a") * F.sqrt("moment_b")
    varies = F.when((F.col("moment_a") > 0) & (F.col("moment_b") > 0), spread)
    return F.when(
        F.col("a") == F.col("b"), F.when(F.col("moment_a") > 0, 1.0)
    ).otherwise(F.col("moment_ab") / varies)


def linear(
    spark: SparkSession, moments: DataFrame, features: Sequence[str]
) -> tuple[DataFrame, float]:
    """Least squares from moments of ``features`` and, last, the target: coefficients, intercept.

    The table has a row per pair of inputs, so its size is that of the model, and it is solved in
    the driver. Rows with a missing value have to be filled or dropped before, as the pairs would
    not be of the same rows. Inputs that do not vary get 0; dependent ones share their effect.
    """
    size = len(features)
    covariance, means = np.zeros((size + 1, size + 1)), np.zeros(size + 1)
    rows = moments.collect()
    if len({row["n"] for row in rows}) > 1:
        raise ValueError("the pairs do not have the same rows")
    for row in rows:
        covariance[row["a"], row["b"]] = covariance[row["b"], row["a"]] = row["moment_ab"]
        means[row["a"]], means[row["b"]] = row["mean_a"], row["mean_b"]
    scale = np.sqrt(np.diag(covariance)[:size])
    scale[scale == 0] = np.inf
    inner = covariance[:size, :size] / np.outer(scale, scale)
    solved, *_ = np.linalg.lstsq(inner, covariance[:size, size] / scale, rcond=1e-12)
    found = solved / scale
    table = spark.createDataFrame(
        [(f, float(v)) for f, v in zip(features, found)], "feature string, coefficient double"
    )
    return table, float(means[size] - found @ means[:size])
