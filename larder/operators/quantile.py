"""Exact quantiles of columns of any size.

The built-in exact ``percentile`` keeps every distinct value of a group in one task. Here a
mergeable sketch proposes values near the wanted ranks, one more pass counts exactly how many
rows lie below each of them, and the two nearest that enclose the ranks bound a band of about one
row in 5,000. A band of more than ``MOST_SORTED`` rows is narrowed in the same way, by a sketch and
counts of its own, and only what is left is sorted, so what meets in one task is bounded whatever
the table's size. Counts are exact, so the two always enclose the ranks, whatever the sketch has
proposed and however few rows there are. Each pass is a map-side combined aggregate over a single
column; its few numbers are read before the next one.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.columns import flag

# A sketch of this accuracy misses a rank by about 1/ACCURACY of the rows it has seen.
ACCURACY = 10000
# How far from a wanted rank values are proposed, in multiples of that error.
STEPS = (0, 1, 2, 4, 16)
# Rows of a band that one task may sort.
MOST_SORTED = 1_000_000
# Quantiles per pass. More counts in one aggregation generate methods the JVM leaves interpreted.
PER_PASS = 3


def _proposed(values: DataFrame, qs: Sequence[float]) -> tuple[int, list[float]]:
    """The number of values, and sorted values near the ranks: the least and greatest included."""
    shares = {min(1.0, max(0.0, q + sign * k / ACCURACY)) for q in qs for k in STEPS for sign in (-1, 1)}
    row = values.agg(
        F.count("v").alias("n"),
        F.min("v").alias("least"),
        F.max("v").alias("greatest"),
        F.percentile_approx("v", sorted(shares), ACCURACY).alias("near"),
    ).first()
    return row.n, sorted({row.least, *row.near, row.greatest}) if row.n else []


class _Band(NamedTuple):
    """Values from ``low`` to ``high``, both there, with ``below`` rows under it and ``rows`` in it."""

    low: float
    high: float
    below: int
    rows: int

    def within(self, values: DataFrame) -> DataFrame:
        return values.filter(F.col("v").between(F.lit(self.low), F.lit(self.high)))


def _counted(values: DataFrame, edges: Sequence[float], below: int) -> list[tuple[float, int, int]]:
    """For each edge: how many rows lie below it, and up to and with it."""
    counts = values.agg(
        *[F.count_if(F.col("v") < F.lit(e)) for e in edges],
        *[F.count_if(F.col("v") <= F.lit(e)) for e in edges],
    ).first()
    n = len(edges)
    return [(e, below + counts[i], below + counts[n + i]) for i, e in enumerate(edges)]


def _enclosing(counted: Sequence[tuple[float, int, int]], ranks: Sequence[int]) -> _Band:
    """The narrowest band between two edges that holds the ranks."""
    low = max((c for c in counted if c[1] <= ranks[0]), key=lambda c: c[0])
    high = min((c for c in counted if c[2] > ranks[-1]), key=lambda c: c[0])
    return _Band(low[0], high[0], low[1], high[2] - low[1])


def _narrowed(values: DataFrame, band: _Band, ranks: Sequence[int]) -> _Band:
    """A band of at most ``MOST_SORTED`` rows, or of one value, that holds the ranks.

    Each round costs two reads and leaves about one row in 5,000. The middle between the ends is
    tried too, so that the band shrinks even if a sketch proposes nothing new.
    """
    while band.rows > MOST_SORTED and band.low < band.high:
        inside = band.within(values)
        shares = [min(1.0, (k - band.below) / max(1, band.rows - 1)) for k in ranks]
        _, edges = _proposed(inside, shares)
        middle = band.low + (band.high - band.low) / 2
        edges = {e for e in (*edges, middle) if band.low <= e <= band.high} | {band.low, band.high}
        found = _enclosing(_counted(inside, sorted(edges), band.below), ranks)
        if found == band:  # no double lies between the ends but those that hold rows
            break
        band = found
    return band


def _values_at(values: DataFrame, band: _Band, ranks: Sequence[int]) -> list[float]:
    """The values at some ranks, all of which lie in a band."""
    if band.low == band.high:
        return [band.low for _ in ranks]
    rows = band.within(values).groupBy("v").count()
    # Unpartitioned on purpose: the band is the bounded remainder described above.
    upto = F.lit(band.below) + F.sum("count").over(Window.orderBy("v"))
    ranked = rows.select("v", upto.alias("upto"))
    return list(ranked.agg(*[F.min(F.when(F.col("upto") > k, F.col("v"))) for k in ranks]).first())


def quantile_values(df: DataFrame, column: str, qs: Sequence[float]) -> list[float | None]:
    """The values at ``qs``, interpolated between their two neighbours; NULL and NaN left out.

    Reads ``df`` two or three times for any three quantiles and one or none more for each other
    one, and two more for every factor of 5,000 that a table has over some 5 * 10^9 rows, so pass
    a written table. None for each where there are no values.
    """
    v = F.col(column).cast("double")
    values = df.select(v.alias("v")).filter("v IS NOT NULL AND NOT isnan(v)")
    found: list[float | None] = []
    for start in range(0, len(qs), PER_PASS):
        some = qs[start : start + PER_PASS]
        n, edges = _proposed(values, some)
        if not n:
            return [None] * len(qs)
        counted = _counted(values, edges, 0)
        for q in some:
            position = (n - 1) * q
            ranks = [math.floor(position), math.ceil(position)]
            band = _narrowed(values, _enclosing(counted, ranks), ranks)
            lower, upper = _values_at(values, band, ranks)
            part = position - ranks[0]
            found.append(lower + (upper - lower) * part if part else lower)
    return found


def exact_quantile(df: DataFrame, column: str, q: float | Sequence[float]) -> DataFrame:
    """``q`` and ``quantile`` for each of the given quantiles."""
    qs = [q] if isinstance(q, float | int) else list(q)
    rows = [(float(k), value) for k, value in zip(qs, quantile_values(df, column, qs))]
    return df.sparkSession.createDataFrame(rows, "q double, quantile double")


def approximate_quantile(df: DataFrame, column: str, q: float) -> DataFrame:
    """One row ``quantile``: a value whose rank is within 1/10,000 of ``q``, in a single pass."""
    return df.agg(F.percentile_approx(column, q, ACCURACY).alias("quantile"))


def flag_above_quantile(
    df: DataFrame, column: str, q: float = 0.99, name: str = "is_outlier", exact: bool = True
) -> DataFrame:
    """Flag, and keep, rows above a quantile of their column.

    The exact one is found first, by two or three jobs over the column.
    """
    if exact:
        bound = F.lit(quantile_values(df, column, [q])[0]).cast("double")
    else:
        bound = approximate_quantile(df, column, q).scalar()
    return df.withColumn(name, flag(F.col(column) > bound))
