"""Nearest neighbours by inner product over balanced posting lists with replicated boundaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.sources.tables import materialize

SAMPLE = 40_000  # vectors that the centroids are fitted on, at most
LIST_SIZE = 1024  # vectors a posting list is meant to hold
MOST_LISTS = 16_384  # centroids, at most; beyond this lists grow, and are split into shards
DEGREE = 24  # links of a centroid in the graph
BEAM = 16  # centroids a graph search expands at least
REPLICAS = 2  # lists a boundary vector is put on, at most
CLOSURE = 1.10  # a vector is also put on a list within this ratio of its nearest's distance
PRUNING = 1.12  # a query reads the lists within this ratio of its nearest centroid's distance
FIRST_LISTS = 4  # lists that a query reads in the first round
BLOCK = 2048  # vectors or queries that a task compares at a time


def take_part(vector: Column, dimension: int) -> Column:
    """Whether a vector is searched: of the table's dimension, finite throughout, and not zero."""
    odd = F.exists(
        vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    )
    some = F.exists(vector, lambda x: x != 0)
    return (F.size(vector) == dimension) & ~F.coalesce(odd, F.lit(True)) & F.coalesce(some, F.lit(False))


def distinct_vectors(vectors: DataFrame, keep: int) -> DataFrame:
    """One row for each different vector: ``key``, ``v``, and the ``keep`` smallest ids.

    Copies can never make a difference beyond those ids, as ties go to the smaller. Ids are
    narrowed down in groups of a key and a part first, so a vector that a third of the rows
    share is spread over many tasks, and each task sends ``keep`` rows of it at most.
    """
    key = ["k1", "k2"]
    rows = vectors.select(
        F.xxhash64("v").alias("k1"),
        F.xxhash64("v", F.lit(1)).alias("k2"),
        "v",
        "vec_id",
        F.pmod(F.xxhash64("vec_id"), F.lit(16)).alias("part"),
    ).distinct()
    for group in ([*key, "part"], key):
        order = Window.partitionBy(*group).orderBy("vec_id")
        rows = rows.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= keep)
    return (
        rows.groupBy(*key)
        .agg(F.first("v").alias("v"), F.array_sort(F.collect_list("vec_id")).alias("ids"))
        .select(F.struct(*key).alias("key"), "v", "ids")
    )


def lift(v: np.ndarray, norm2: float) -> np.ndarray:
    """Vectors with a component more, which makes all of one length: then the largest inner
    product with a query is the smallest distance."""
    rest = np.sqrt(np.maximum(norm2 - (v**2).sum(axis=1), 0))
    return np.c_[v, rest]


def distances2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a**2).sum(axis=1)[:, None] - 2 * a @ b.T + (b**2).sum(axis=1)
    return np.maximum(d, 0)


def balanced_centroids(v: np.ndarray, lists: int, seed: int = 7) -> np.ndarray:
    """Centres of groups of like size: groups are halved by two means, at the median."""
    rng = np.random.default_rng(seed)
    groups = [(np.arange(len(v)), lists)]
    centres = []
    while groups:
        rows, parts = groups.pop()
        if parts == 1 or len(rows) < 2:
            centres.append(v[rows].mean(axis=0))
            continue
        two = v[rng.choice(rows, 2, replace=False)]
        left = parts // 2
        for _ in range(6):
            side = distances2(v[rows], two)
            order = np.argsort(side[:, 0] - side[:, 1], kind="stable")
            cut = max(1, min(len(rows) - 1, round(len(rows) * left / parts)))
            first, second = rows[order[:cut]], rows[order[cut:]]
            two = np.stack([v[first].mean(axis=0), v[second].mean(axis=0)])
        groups += [(first, left), (second, parts - left)]
    return np.array(centres)


def neighbour_graph(centres: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """For each centroid the nearest others and, last, a link that keeps the graph in one piece."""
    n = len(centres)
    degree = min(degree, max(n - 1, 1))
    links = np.zeros((n, degree + 1), np.int64)
    for low in range(0, n, 1024):
        d = distances2(centres[low : low + 1024], centres)
        d[np.arange(len(d)), np.arange(low, low + len(d))] = np.inf
        near = np.argpartition(d, degree - 1, axis=1)[:, :degree]
        links[low : low + 1024, :degree] = near
    links[:, degree] = (np.arange(n) + 1) % n
    return links


def search_graph(
    queries: np.ndarray,
    centres: np.ndarray,
    links: np.ndarray,
    ratio: float = PRUNING,
    beam: int = BEAM,
) -> list[np.ndarray]:
    """For each query the centroids within ``ratio`` of its nearest one's distance, in order.

    All queries walk the graph at once from starts spread over the centroids. In each round a
    query expands what it has met and not expanded among its ``beam`` best and within ``ratio``
    of its best, so it ends when all of these are expanded. Only met centroids are measured.
    """
    n, q = len(centres), len(queries)
    starts = np.unique(np.linspace(0, n - 1, min(n, 16)).astype(int))
    d = np.full((q, n), np.inf)
    d[:, starts] = distances2(queries, centres[starts])
    expanded = np.zeros((q, n), bool)
    while True:
        best = d.min(axis=1, keepdims=True)
        edge = np.partition(d, min(beam, n) - 1, axis=1)[:, min(beam, n) - 1 : min(beam, n)]
        ahead = np.isfinite(d) & (d <= np.maximum(edge, ratio**2 * best)) & ~expanded
        row, at = np.nonzero(ahead)
        if not len(row):
            order = np.argsort(d, axis=1, kind="stable")
            return [row[:n] for row, n in zip(order, (d <= ratio**2 * best).sum(axis=1))]
        expanded[row, at] = True
        met = np.zeros((q, n), bool)
        met[row[:, None], links[at]] = True
        row, at = np.nonzero(met & np.isinf(d))
        d[row, at] = ((centres[at] - queries[row]) ** 2).sum(axis=1)


def closure(
    v: np.ndarray, centres: np.ndarray, ratio: float = CLOSURE, most: int = REPLICAS
) -> list[np.ndarray]:
    """The lists of each vector: its nearest, and the next ones that are nearly as near."""
    out = []
    most = min(most, len(centres))
    for low in range(0, len(v), 256):
        d = distances2(v[low : low + 256], centres)
        near = np.argpartition(d, most - 1, axis=1)[:, :most]
        near_d = np.take_along_axis(d, near, 1)
        order = np.argsort(near_d, axis=1, kind="stable")
        near, near_d = (np.take_along_axis(x, order, 1) for x in (near, near_d))
        out += [row[keep] for row, keep in zip(near, near_d <= ratio**2 * near_d[:, :1])]
    return out


def top(queries: np.ndarray, members: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Query, member and inner product of the ``k`` best of each query; ties go to the earlier.

    A fast product narrows members down; what is left is summed in one order, so that a pair
    has the same score in whatever block it is met.
    """
    found = []
    largest = np.abs(members).max(initial=0)
    for low in range(0, len(queries), 256):
        part = queries[low : low + 256]
        rough = part @ members.T
        slack = 1e-9 * np.abs(part).sum(axis=1, keepdims=True) * largest
        edge = np.partition(rough, -k, axis=1)[:, -k:][:, :1] if len(members) > k else -np.inf
        q, m = np.nonzero(rough >= edge - slack)
        scores = np.empty(len(q))
        for at in range(0, len(q), 1 << 16):  # ties may be many
            chosen = slice(at, at + (1 << 16))
            scores[chosen] = (members[m[chosen]] * part[q[chosen]]).sum(axis=1)
        order = np.lexsort((m, -scores, q))
        q, m, scores = q[order], m[order], scores[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = place < k
        found.append((q[keep] + low, m[keep], scores[keep]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _stack(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64)


def fit(vectors: DataFrame, n: int, sample: int, list_size: int, most_lists: int):
    """Centroids in the lifted space, their graph, and the greatest squared length.

    Fitted on the vectors with the ``sample`` smallest keys; ``vectors`` has been made distinct.
    """
    norm2 = vectors.agg(
        F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    ).first()[0]
    rows = vectors.select("v").orderBy("key").limit(sample).toPandas()
    v = lift(_stack(rows["v"]), norm2)
    lists = max(1, min(most_lists, len(v) // 8 or 1, -(-n // list_size)))
    centres = balanced_centroids(v, lists)
    return centres, neighbour_graph(centres), float(norm2)


def _cells(members: DataFrame, routed: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Both dealt out to cells: a ``row`` of a list's members against a ``col`` of its queries.

    A cell holds about ``block`` of either, so neither a long list nor one that many queries read
    meets in a task. The numbers of blocks are one row a list, of which there are a bounded few.
    """

    def blocks(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("list").agg(F.ceil(F.count("*") / block).alias(name))

    grid = F.broadcast(blocks(members, "rows").join(blocks(routed, "cols"), "list"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    mine = members.join(grid, "list").withColumns(
        {"row": F.pmod(F.xxhash64("k1", "k2"), "rows"), "col": each("cols")}
    )
    theirs = routed.join(grid, "list").withColumns(
        {"col": F.pmod(F.xxhash64("q1", "q2"), "cols"), "row": each("rows")}
    )
    return mine.drop("rows", "cols"), theirs.drop("rows", "cols")


def _best(members: DataFrame, routed: DataFrame, k: int, kinds: str, block: int) -> DataFrame:
    """The ``k`` + 1 best vectors of each query among the lists it reads: q1, q2, k1, k2, score.

    Lists are read in rounds, the nearest first and four times as many in each. From the second
    round on only vectors come back that are as good as the last of those found before, so what
    is shuffled for a query hardly grows with the lists it reads.
    """
    query = ["q1", "q2"]

    def compare(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        if mine.empty or theirs.empty:
            return pd.DataFrame(columns=["q1", "q2", "k1", "k2", "low", "score"])
        mine = mine.sort_values("low")
        q, m, scores = top(_stack(theirs["v"]), _stack(mine["v"]), k + 1)
        keep = scores >= theirs["bound"].to_numpy()[q]
        q, m, scores = q[keep], m[keep], scores[keep]
        return pd.DataFrame(
            {
                "q1": theirs["q1"].to_numpy()[q],
                "q2": theirs["q2"].to_numpy()[q],
                "k1": mine["k1"].to_numpy()[m],
                "k2": mine["k2"].to_numpy()[m],
                "low": mine["low"].to_numpy()[m],
                "score": scores,
            }
        )

    schema = f"q1 long, q2 long, k1 long, k2 long, low {kinds}, score double"
    best = members.sparkSession.createDataFrame([], schema)
    last = routed.agg(F.max("at")).first()[0]
    low, high = 0, FIRST_LISTS
    while last is not None and low <= last:
        enough = F.when(F.count("*") == k + 1, F.min("score")).otherwise(float("-inf"))
        bounds = best.groupBy(*query).agg(enough.alias("bound"))
        some = routed.filter((F.col("at") >= low) & (F.col("at") < high))
        some = some.join(bounds, query, "left").fillna(float("-inf"), "bound")
        mine, theirs = _cells(members, some, block)
        cell = ["list", "row", "col"]
        pairs = mine.groupBy(*cell).cogroup(theirs.groupBy(*cell)).applyInPandas(compare, schema)
        once = (
            pairs.unionByName(best)
            .groupBy(*query, "k1", "k2")
            .agg(F.first("low").alias("low"), F.max("score").alias("score"))
        )
        order = Window.partitionBy(*query).orderBy(F.desc("score"), "low")
        ranked = once.withColumn("at", F.row_number().over(order))
        best = materialize(ranked.filter(F.col("at") <= k + 1).drop("at"), "best")
        low, high = high, 4 * high
    return best.drop("low")


def nearest(
    vectors: DataFrame,
    queries: Column | str,
    k: int = 20,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    sample: int = SAMPLE,
    list_size: int = LIST_SIZE,
    most_lists: int = MOST_LISTS,
    pruning: float = PRUNING,
    block: int = BLOCK,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` nearest found for each query.

    ``queries`` is a condition on ``vec_id`` that chooses the query rows; candidates are all
    rows with another id. Scores are inner products in double precision; ties go to the smaller
    id. Vectors that are null, zero, of another than the commonest dimension (of the smaller,
    where two are as common), or hold nulls or non-finite numbers take no part, nor do rows
    with a null id. Of rows with the same id and vector one counts. Fewer candidates give fewer
    rows, an empty table none. Other columns are ignored.

    Every vector is put on a posting list, and on those of other centroids nearly as near.
    Centroids are found by a walk over a graph held in memory; a query reads the lists whose
    distance is within ``pruning`` of the nearest's. Lists and their queries are compared in
    blocks of ``block``, so a list may be of any size. The search is approximate; its recall is
    measured in the tests.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("v"))
    sizes = rows.filter("v is not null").groupBy(F.size("v").alias("d")).count()
    common = sizes.orderBy(F.desc("count"), "d").first()
    rows = rows.filter(
        F.col("vec_id").isNotNull() & take_part(F.col("v"), common.d if common else 0)
    )
    kinds = rows.schema["vec_id"].dataType.simpleString()
    base = materialize(distinct_vectors(rows, k + 1), "vectors")
    n = base.count()
    out = f"query_id {kinds}, rank int, vec_id {kinds}, score double"
    if not n:
        return spark.createDataFrame([], out)
    context = spark.sparkContext
    shared = context.broadcast(fit(base, n, sample, list_size, most_lists))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres, _, norm2 = shared.value
        for batch in batches:
            lists = closure(lift(_stack(batch["v"]), norm2), centres)
            yield batch.assign(list=lists).explode("list").astype({"list": int})

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres, links, _ = shared.value
        for batch in batches:
            for low in range(0, len(batch), 128):
                part = batch.iloc[low : low + 128]
                v = _stack(part["v"])
                lists = search_graph(np.c_[v, np.zeros(len(v))], centres, links, pruning)
                lengths = [len(found) for found in lists]
                yield part.loc[part.index.repeat(lengths)].assign(
                    list=np.concatenate(lists), at=np.concatenate([np.arange(n) for n in lengths])
                )

    members = materialize(
        base.select("key.k1", "key.k2", "v", F.col("ids")[0].alias("low")).mapInPandas(
            assign, f"k1 long, k2 long, v array<float>, low {kinds}, list int"
        ),
        "postings",
    )
    asked = rows.filter(queries).select(
        F.xxhash64("v").alias("q1"), F.xxhash64("v", F.lit(1)).alias("q2"), "vec_id", "v"
    )
    asked = materialize(asked.distinct(), "queries")
    routed = materialize(
        asked.groupBy("q1", "q2")
        .agg(F.first("v").alias("v"))
        .mapInPandas(route, "q1 long, q2 long, v array<float>, list int, at int"),
        "routes",
    )
    best = _best(members, routed, k, kinds, block)
    best = best.join(base.select("key.k1", "key.k2", "ids"), ["k1", "k2"])
    query = ["q1", "q2"]
    each = best.select(*query, "score", F.explode("ids").alias("id"))
    order = Window.partitionBy(*query).orderBy(F.desc("score"), "id")
    ranked = (
        each.withColumn("at", F.row_number().over(order))
        .filter(F.col("at") <= k + 1)
        .groupBy(*query)
        .agg(F.array_sort(F.collect_list(F.struct("at", "id", "score"))).alias("found"))
    )
    others = F.slice(F.filter("found", lambda f: f["id"] != F.col("vec_id")), 1, k)
    return (
        asked.select(*query, "vec_id")
        .join(ranked, query)
        .select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("at", "f"))
        .select(
            "query_id",
            (F.col("at") + 1).alias("rank"),
            F.col("f.id").alias("vec_id"),
            F.col("f.score").alias("score"),
        )
    )
