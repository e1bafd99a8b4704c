import random

import brute
import pytest
from pyspark.sql import functions as F

from larder.llm import mix

SCHEMA = "doc_id long, text string, source string"


def made(n=300, seed=1):
    rng = random.Random(seed)
    sources = ["a", "b", "C", "ä", None, "tiny"]
    rows = []
    for i in range(n):
        source = rng.choices(sources, (40, 20, 10, 10, 10, 1))[0]
        size = rng.choice([0, 1, 5, 30, 200, 3000]) if source != "tiny" else 2
        rows.append((i, " ".join(rng.choice("xyz") for _ in range(size)), source))
    rows += [(None, "p q\tr\x0bs t", "a"), (7, None, "b"), (8, "", None), rows[3], rows[3]]
    return rows


def test_targets_and_copies_as_by_hand(spark):
    rows = made()
    want = brute.mix(rows)
    sizes = [len(brute.words_of(t)) for _, t, _ in rows]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mix.shares(df).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.doc_id, r.size, r.taken) for r in got), key=key) == sorted(
        ((row[0], n, n * c) for row, n, c in zip(rows, sizes, want)), key=key
    )
    by_source = {}
    for n, row in zip(sizes, rows):
        by_source[row[2]] = by_source.get(row[2], 0) + n
    targets = brute.targets(by_source)
    assert sum(targets.values()) == pytest.approx(sum(sizes))
    planned = mix.source_targets(df.select("source", mix.size_of(df.text).alias("size"))).collect()
    assert {r.source: r.target for r in planned} == pytest.approx(targets)
    assert any(t == 3 * by_source[s] for s, t in targets.items())  # the cap is at work
    for source, target in targets.items():
        taken = sum(n * c for row, n, c in zip(rows, sizes, want) if row[2] == source)
        assert abs(taken - target) <= max(n for row, n in zip(rows, sizes) if row[2] == source)
    assert all(r.taken <= 3 * r.size for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mix.shares(df.repartition(5)).collect()))


def test_rows_of_the_mix(spark):
    rows = made(80)
    df = spark.createDataFrame(rows, SCHEMA).withColumns(
        {c: F.lit(c) for c in ("size", "rank", "whole", "target", "plan", "row", "_of", "copy", "n")}
    )
    got = mix.mix(df)
    assert got.columns == [c for c in df.columns if c != "copy"] + ["copy"]
    assert {r["rank"] for r in got.collect()} == {"rank"}
    counts = {}
    for r in got.collect():
        key = (r.doc_id, r.text, r.source)
        counts[key] = counts.get(key, 0) + 1
    want = {}
    for row, c in zip(rows, brute.mix(rows)):
        if c:
            want[row] = want.get(row, 0) + c
    assert counts == want


def test_empty_and_wordless(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mix.shares(empty).count() == 0 and mix.mix(empty).count() == 0
    none = spark.createDataFrame([(1, None, "a"), (None, " ", None)], SCHEMA)
    assert [(r.size, r.target, r.taken) for r in mix.shares(none).collect()] == [(0, 0.0, 0)] * 2


def test_stays_in_the_jvm(spark):
    plan = mix.shares(spark.createDataFrame(made(20), SCHEMA))
    text = plan._jdf.queryExecution().toString()
    assert "Python" not in text and "Arrow" not in text and "Pandas" not in text
