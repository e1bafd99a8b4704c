"""Connected components of a graph given as edges, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.sources.tables import materialize


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*").alias("n"),
        F.expr("bit_xor(xxhash64(a, b))").alias("x"),
        F.expr("bit_xor(xxhash64(b, a, 1))").alias("y"),
    ).first()
    return row.n, row.x, row.y


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return (
        both.join(least, "a")
        .filter(F.col("b") > F.col("a"))
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
        .filter("a <> b")
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.withColumnRenamed("m", "b")).filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """The smallest node of its component for every node that is not itself the smallest.

    ``edges`` has two columns of one orderable type, ``a`` and ``b``, in any direction; loops
    and repeats are allowed, nulls are not. Returns ``node`` and ``root``. Each round is two
    grouped minima and two joins, and is written to the shared folder; the number of rounds
    grows with the logarithm of the graph's size. A hub's minimum is taken by partial
    aggregates and its join is split by adaptive execution, so no node's edges meet in a task.
    No edges give no rows.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = materialize(edges.filter("a <> b").distinct(), "edges")
    before = _fingerprint(edges)
    while before[0]:
        edges = materialize(_small_star(_large_star(edges)), "edges")
        after = _fingerprint(edges)
        if after == before:
            break
        before = after
    return edges.toDF("node", "root")
