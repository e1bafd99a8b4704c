import random

import brute
import numpy as np
from conftest import SF
from pyspark.sql import functions as F

from larder.llm import ann
from larder.llm.common import read

EVERY_20TH = "vec_id % 20 = 0"


def recall(got, want):
    return len({(q, i) for q, _, i, _ in got} & {(q, i) for q, _, i, _ in want}) / len(want)


def test_recall_and_scores_on_the_test_table(spark):
    """Noise without any structure: the hardest case, as all lists are about as near."""
    df = read(spark, SF.replace("sf0.001", "sf0.1"), "embeddings")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want = brute.nearest(rows, lambda i: i % 20 == 0, 20)
    assert recall([tuple(r) for r in ann.nearest(df, EVERY_20TH).collect()], want) >= 0.97
    # Small lists, so that the table makes many, and a wider ratio as small lists need.
    got = [tuple(r) for r in ann.nearest(df, EVERY_20TH, list_size=64, pruning=1.2).collect()]
    assert recall(got, want) >= 0.9
    vectors = {i: np.array(v, float) for i, v in rows}
    assert all(abs(s - float(vectors[q] @ vectors[i])) < 1e-12 for q, _, i, s in got)
    by_query = {}
    for q, rank, i, s in sorted(got):
        assert i != q
        by_query.setdefault(q, []).append((-s, i))
        assert rank == len(by_query[q])
    assert all(found == sorted(found) and len(found) == 20 for found in by_query.values())


def made(seed=1):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 1) * (1 + i % 5) for _ in range(8)]) for i in range(240)]
    same = [1.5, -2.0, 0.5, 0.0, 1.0, -1.0, 2.0, 0.25]
    rows += [(1000 + i, same) for i in range(120)]  # a third are copies of one
    return rows + [(3000 + i, [float(i % 2 * 2 - 1)] + [0.0] * 7) for i in range(40)]


def test_exact_where_one_list_holds_all(spark):
    """Unequal lengths, copies, ties and repeated rows, against brute force."""
    rows = made()
    df = spark.createDataFrame(rows + rows[:7], "vec_id long, embedding array<double>")
    want = brute.nearest(rows, lambda i: i % 20 == 0, 20)
    got = [tuple(r) for r in ann.nearest(df, EVERY_20TH).collect()]
    assert [g[:3] for g in sorted(got)] == [w[:3] for w in sorted(want)]
    assert np.allclose([g[3] for g in sorted(got)], [w[3] for w in sorted(want)], atol=1e-12)
    # Lists and queries dealt out in small blocks give the same.
    assert sorted(tuple(r) for r in ann.nearest(df, EVERY_20TH, block=30).collect()) == sorted(got)


def test_recall_with_unequal_lengths(spark):
    rows = made(2)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute.nearest(rows, lambda i: i % 20 == 0, 20)
    got = [tuple(r) for r in ann.nearest(df, EVERY_20TH, list_size=40, sample=100).collect()]
    assert len(got) == len(want) and recall(got, want) >= 0.9


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (20, [0.0, 2.0]), (1, [1.0, 1.0]), (2, None), (40, [0.0, 0.0]), (3, [nan, 1.0]),
        (4, [inf, 1.0]), (5, [1.0]), (6, []), (None, [9.0, 9.0]), (60, [None, 1.0]), (1, [1.0, 1.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in ann.nearest(df.withColumn("list", F.lit(1)), EVERY_20TH).collect())
    assert got == [(0, 1, 1, 1.0), (0, 2, 20, 0.0), (20, 1, 1, 2.0), (20, 2, 0, 0.0)]
    assert ann.nearest(df.limit(0), EVERY_20TH).columns == ["query_id", "rank", "vec_id", "score"]
    for some in (df.limit(0), df.filter("vec_id in (2, 40)"), df.filter("vec_id = 0")):
        assert ann.nearest(some, EVERY_20TH).count() == 0


def test_graph_walk_finds_the_lists_within_the_ratio():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(300, 6))
    links = ann.neighbour_graph(centres)
    queries = rng.normal(size=(40, 6))
    d = ann.distances2(queries, centres)
    found = ann.search_graph(queries, centres, links, 1.3)
    want = [set(np.flatnonzero(row <= 1.3**2 * row.min())) for row in d]
    hit = sum(len(w & set(f.tolist())) for w, f in zip(want, found))
    assert hit >= 0.98 * sum(map(len, want))
    assert all(len(f) for f in found)


def test_groups_are_balanced():
    rng = np.random.default_rng(4)
    v = np.r_[rng.normal(size=(900, 4)), rng.normal(5, 0.01, size=(100, 4))]
    for lists in (1, 3, 10):
        centres = ann.balanced_centroids(v, lists)
        assert len(centres) == lists and np.isfinite(centres).all()
