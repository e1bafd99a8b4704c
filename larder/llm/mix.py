"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import SPACES
from larder.sources.tables import materialize

WEIGHTS = (5.0, 2.0, 1.0)  # of the sources in order, repeating
MOST_COPIES = 3.0
STEPS_PER_OCTAVE = 256  # of the ranking variable's histogram


def size_of(text: Column) -> Column:
    """The words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACES)), F.lit(0)).cast("long")


def random_odds(doc_id: Column, text: Column) -> Column:
    """The odds u / (1 - u) of a number u between 0 and 1 that the id and the text fix."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    digits = F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("double")
    u = (digits + 0.5) / float(1 << 48)
    return u / (1 - u)


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most_copies: float = MOST_COPIES
) -> DataFrame:
    """``source``, ``source_size`` and ``target``: the words each source gives to the mix.

    The targets share the size of all sources by weight. None exceeds ``most_copies`` times its
    source; what is above goes to the others by weight, again and again. The end of that is a
    water level: filled in the order of capacity per weight, the first sources are full and the
    others share the rest. The windows here run in one task over one row a source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    listed = F.array(*[F.lit(float(w)) for w in weights])
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = Window.orderBy("fullness", F.col("source").asc_nulls_last())
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    upto = filled.rowsBetween(Window.unboundedPreceding, 0)
    after = filled.rowsBetween(0, Window.unboundedFollowing)
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    return (
        totals.withColumn("weight", listed[(F.row_number().over(order) - 1) % len(weights)])
        .withColumn("capacity", F.col("source_size") * most_copies)
        .withColumn("fullness", F.col("capacity") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn(
            "level",
            (F.col("total") - F.coalesce(F.sum("capacity").over(before), F.lit(0.0)))
            / F.sum("weight").over(after),
        )
        # The level at the first source that is not full holds for it and all later ones.
        .withColumn("open", F.when(F.col("level") * F.col("weight") <= F.col("capacity"), F.col("level")))
        .withColumn("level", F.first("open", ignorenulls=True).over(upto))
        .select(
            "source",
            "source_size",
            F.coalesce(
                F.least(F.col("level") * F.col("weight"), "capacity"), "capacity"
            ).alias("target"),
        )
    )


def measure(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> dict[str, Column]:
    """Columns ``size`` and ``rank``: random odds divided by inclusion odds.

    Within a source a document's inclusion odds are in proportion to its size. Their common
    factor, which depends on the words a source has to give, doesn't change the order.
    """
    size = size_of(docs[text])
    return {"size": size, "rank": random_odds(docs[doc_id], docs[text]) / F.nullif(size, F.lit(0))}


def _by_source(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on ``source``, null to null; the right one's other columns are added."""
    right = right.withColumnRenamed("source", "_of")
    return left.join(right, F.col("source").eqNullSafe(F.col("_of")), how).drop("_of")


def plan(measured: DataFrame, targets: DataFrame) -> DataFrame:
    """``targets`` with how to choose in each source, one row each, written to the shared folder.

    All documents get ``whole`` copies. Ranks up to ``last_rank`` get one more, so many that
    the words come as near the target as they can from below. The document with ``fitting_rank``
    gets one more too, if there is one whose size brings them nearer.

    Ranks are laid out in a histogram of fixed fine steps, summed before the shuffle. Only the
    documents of the step in which a source's missing words run out are sorted, less than one
    in a thousand of the source.
    """
    size = F.col("source_size")
    targets = targets.withColumn(
        "whole", F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("long")
    ).withColumn("missing", F.col("target") - F.col("whole") * size)
    ranked = measured.filter("size > 0").select(
        "source", "size", "rank", F.floor(F.log2("rank") * STEPS_PER_OCTAVE).alias("step")
    )
    below = Window.partitionBy("source").orderBy("step").rowsBetween(
        Window.unboundedPreceding, -1
    )
    steps = (
        ranked.groupBy("source", "step")
        .agg(F.sum("size").alias("words"))
        .withColumn("before", F.coalesce(F.sum("words").over(below), F.lit(0)))
    )
    turning = (
        _by_source(steps, targets.select("source", "missing"))
        .filter("before <= missing and missing < before + words")
        .select("source", F.col("step").alias("turn"), "before", "missing")
    )
    upto = Window.partitionBy("source").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    lasts = (
        _by_source(ranked, turning)
        .filter("step = turn")
        .groupBy("source", "rank", "before", "missing")
        .agg(F.sum("size").alias("size"))
        .withColumn("upto", F.col("before") + F.sum("size").over(upto))
        .withColumn("fits", F.col("upto") <= F.col("missing"))
        .groupBy("source")
        .agg(
            F.max(F.when(F.col("fits"), F.col("rank"))).alias("last_in_step"),
            F.coalesce(F.max(F.when(F.col("fits"), F.col("upto"))), F.max("before")).alias("chosen"),
        )
    )
    # Where nothing of the step itself fits, the last rank is the greatest of the steps below.
    highest = (
        _by_source(ranked, turning)
        .filter("step < turn")
        .groupBy("source")
        .agg(F.max("rank").alias("last_below"))
    )
    chosen = _by_source(_by_source(targets, lasts, "left"), highest, "left").select(
        *targets.columns,
        F.coalesce("last_in_step", "last_below", F.lit(0.0)).alias("last_rank"),
        (F.col("missing") - F.coalesce("chosen", F.lit(0))).alias("left_over"),
    )
    chosen = materialize(chosen, "chosen")
    off = F.abs(F.col("size") - F.col("left_over"))
    fitting = (
        _by_source(ranked, chosen.select("source", "last_rank", "left_over"))
        .filter((F.col("rank") > F.col("last_rank")) & (off < F.col("left_over")))
        .groupBy("source")
        .agg(F.min(F.struct(off.alias("off"), "rank")).alias("best"))
        .select("source", F.col("best.rank").alias("fitting_rank"))
    )
    return materialize(_by_source(chosen, fitting, "left"), "mix")


def copies(size: Column, rank: Column) -> Column:
    """How often a document is taken, next to the columns of its source's plan."""
    more = (size > 0) & ((rank <= F.col("last_rank")) | (rank.eqNullSafe(F.col("fitting_rank"))))
    return F.when(size > 0, F.col("whole") + F.when(more, 1).otherwise(0)).otherwise(0).cast("long")


def shares(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = WEIGHTS,
    most_copies: float = MOST_COPIES,
) -> DataFrame:
    """One row per document: ``doc_id``, ``size``, ``source_size``, ``target``, ``taken``.

    ``taken`` are the words the mix takes of it, repeats counted. Rows of the same id and text
    share their fate. Null and empty texts have size 0 and are not taken; a null source is a
    source like others and comes last; a source without words has target 0. Extra columns are
    ignored whatever their names. No rows give no rows. Reruns agree: chance comes from a hash
    of the id and the text.
    """
    measured = docs.select(
        docs[doc_id].alias("doc_id"),
        docs[source].alias("source"),
        *[column.alias(name) for name, column in measure(docs, text, doc_id).items()],
    )
    measured = materialize(measured, "measured")
    chosen = plan(measured, source_targets(measured, weights, most_copies))
    return _by_source(measured, chosen).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * copies(F.col("size"), F.col("rank"))).alias("taken"),
    )


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = WEIGHTS,
    most_copies: float = MOST_COPIES,
) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with ``copy`` from 1.

    The same choice as in `shares`. A column named ``copy`` is replaced.
    """
    own = docs.drop("copy")
    measured = own.select(
        own[source].alias("source"),
        *[column.alias(name) for name, column in measure(own, text, doc_id).items()],
    )
    measured = materialize(measured, "measured")
    chosen = plan(measured, source_targets(measured, weights, most_copies))
    row = F.struct(*[own[c] for c in own.columns]).alias("row")
    columns = measure(own, text, doc_id)
    rows = own.select(row, own[source].alias("source"), *[c.alias(n) for n, c in columns.items()])
    taken = _by_source(rows, chosen).withColumn("n", copies(F.col("size"), F.col("rank")))
    return (
        taken.filter("n > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
        .select("row.*", "copy")
    )
