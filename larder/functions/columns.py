"""Column expressions shared by the operators. All of them stay inside Catalyst."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Generated methods of more bytes are left interpreted by the JVM.
COMPILED_BYTES = 8000


def row_hash(columns: Iterable[str | Column], null_token: str | None = None) -> Column:
    """SHA-256 over the values joined by ``||``.

    Without ``null_token`` NULLs leave no trace, so ``("a", NULL)`` and ``(NULL, "a")`` share a
    hash; with it every NULL is written out as the token.
    """
    parts = [F.col(c) if isinstance(c, str) else c for c in columns]
    if null_token is not None:
        parts = [F.coalesce(p.cast("string"), F.lit(null_token)) for p in parts]
    return F.sha2(F.concat_ws("||", *parts), 256)


def flag(condition: Column) -> Column:
    """1 where the condition is true, 0 where it is false or unknown."""
    return F.when(condition, 1).otherwise(0)


def guarded_ratio(numerator: Column, denominator: Column, default: float) -> Column:
    """``numerator / denominator`` for a positive denominator, ``default`` otherwise."""
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(default))


def first_below(value: Column, edges: Sequence[tuple[float, object]], otherwise: object) -> Column:
    """Label of the first edge the value lies below; NULL values take ``otherwise``."""
    labels = [F.when(value < edge, F.lit(label)) for edge, label in edges]
    return F.coalesce(*labels, F.lit(otherwise))


def first_above(value: Column, edges: Sequence[tuple[float, object]], otherwise: object) -> Column:
    """Label of the first edge the value lies above; NULL values take ``otherwise``."""
    labels = [F.when(value > edge, F.lit(label)) for edge, label in edges]
    return F.coalesce(*labels, F.lit(otherwise))


def lookup(value: Column, mapping: Mapping[str, object], otherwise: object | Column) -> Column:
    """Translate codes through a small fixed mapping."""
    labels = [F.when(value == code, F.lit(label)) for code, label in mapping.items()]
    return F.coalesce(*labels, otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def keep_compiled(spark: SparkSession) -> None:
    """From now on let Spark split up generated code that the JVM would not compile.

    Spark puts all expressions of a projection into one method, up to 64 KB. Past
    ``COMPILED_BYTES`` that runs interpreted; below this limit Spark splits it. No result depends on it.
    """
    name = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(name)) > COMPILED_BYTES:
        spark.conf.set(name, str(COMPILED_BYTES))


def round_half_up(value: Column, digits: int) -> Column:
    """What ``round`` gives for a double, which goes by the decimals that it is written with.

    Away from the middle between two results, and below 10^9 units, the nearest one is found by
    plain arithmetic, without a decimal number per value; the rest is left to ``round``.
    """
    units = value * F.lit(10.0**digits)
    nearest = F.rint(units)
    clear = (F.abs(units - nearest) < 0.499) & (F.abs(units) < 1e9)
    return F.when(clear, nearest / F.lit(10.0**digits)).otherwise(F.round(value, digits))


def pass_fail(ok: Column, failed: str = "FAIL") -> Column:
    return F.when(ok, F.lit("PASS")).otherwise(F.lit(failed))


def to_rows(one_row: DataFrame, rows: Sequence[Mapping[str, Column]]) -> DataFrame:
    """Turn a one-row aggregate into one output row per mapping, without another aggregation."""
    structs = [F.struct(*[c.alias(name) for name, c in row.items()]) for row in rows]
    return one_row.select(F.inline(F.array(*structs)))


# Coefficients of the AS 241 (PPND16) rational approximation, highest power first.
_CENTRE = (
    (2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457,
     13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.387132872796366608),
    (5226.495278852545925, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867,
     5394.1960214247511077, 687.1870074920579083, 42.313330701600911252, 1.0),
)
_MIDDLE = (
    (7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177,
     1.27045825245236838258, 3.64784832476320460504, 5.7694972214606914055,
     4.6303378461565452959, 1.42343711074968357734),
    (1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966,
     0.14810397642748007459, 0.68976733498510000455, 1.6763848301838038494,
     2.05319162663775882187, 1.0),
)
_TAIL = (
    (2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386,
     0.026532189526576123093, 0.29656057182850489123, 1.7848265399172913358,
     5.4637849111641143699, 6.6579046435011037772),
    (2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5,
     7.868691311456132591e-4, 0.0148753612908506148525, 0.13692988092273580531,
     0.59983220655588793769, 1.0),
)


def _polynomial(coefficients: Sequence[float], x: Column) -> Column:
    value = F.lit(coefficients[0])
    for c in coefficients[1:]:
        value = value * x + F.lit(c)
    return value


def _rational(pair, x: Column) -> Column:
    return _polynomial(pair[0], x) / _polynomial(pair[1], x)


def normal_quantile(p: float | Column) -> Column:
    """Standard normal quantile of a literal level or, row by row, of a column.

    Levels outside the open interval (0, 1) give NULL in the column form.
    """
    if not isinstance(p, Column):
        return F.lit(NormalDist().inv_cdf(float(p)))
    p = F.when((p > 0) & (p < 1), p.cast("double"))
    q = p - 0.5
    depth = F.sqrt(-F.log(F.least(p, 1 - p)))
    tail = F.when(depth <= 5, _rational(_MIDDLE, depth - 1.6)).otherwise(
        _rational(_TAIL, depth - 5)
    )
    return F.when(F.abs(q) <= 0.425, q * _rational(_CENTRE, 0.180625 - q * q)).otherwise(
        F.signum(q) * tail
    )
