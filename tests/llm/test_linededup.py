import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.llm import linededup

SCHEMA = "doc_id long, text string"


def documents(seed=1, n=60):
    rng = random.Random(seed)
    pool = [" ".join(f"w{rng.randrange(900)}" for _ in range(rng.choice([1, 4, 9, 20, 60]))) for _ in range(14)]
    rows = []
    for i in range(n):
        lines = []
        while rng.random() < 0.85:
            if rng.random() < 0.5:
                at = rng.randrange(len(pool))
                lines += pool[at : at + rng.randint(1, 6)]
            else:
                lines.append(" ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randint(0, 30))))
            if rng.random() < 0.2:
                lines.append(rng.choice(["", "  ", "\t"]))
        rows.append((i, "\n".join(lines)))
    passage = " ".join(f"p{k}" for k in range(60))
    return rows + [
        (n, f"head\n{passage}\ntail"),
        (n + 1, f"  {passage} \r\nother"),
        (n + 2, passage),
        (n + 3, None),
        (n + 4, ""),
        (n + 5, "\n".join(["a b c"] * 100)),
        (n + 6, "\n" * 500 + passage),
        rows[5],
        (None, rows[6][1]),
    ]


def in_order(rows):
    return sorted(enumerate(rows), key=lambda x: (x[1][0] is None, x[1][0] or 0, x[0]))


def test_cuts_what_the_slow_version_cuts(spark):
    for seed in (1, 2, 3):
        rows = documents(seed)
        order = in_order(rows)
        cuts = brute.repeated_lines([r[1] for _, r in order])
        want = sorted(
            str((r[0], brute.without_lines(r[1], cut) if cut else r[1]))
            for (_, r), cut in zip(order, cuts)
        )
        df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
        df = df.withColumns({c: F.lit(c) for c in ("_row", "place", "low", "at", "words")})
        got = linededup.dedup(df)
        assert got.columns == [*df.columns, "lines_removed", "words_removed"]
        assert sorted(str((r.doc_id, r.text)) for r in got.collect()) == want
        assert sum(map(len, cuts)) > 50


def test_removals_say_the_same(spark):
    rows = documents(4)
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1).withColumn("row", F.monotonically_increasing_id())
    got = {r.row: r for r in linededup.removals(df, "row").collect()}
    assert len(got) == len(rows)
    cuts = {i: cut for (i, _), cut in zip(in_order(rows), brute.repeated_lines([r[1] for _, r in in_order(rows)]))}
    for i, (doc_id, text) in enumerate(rows):
        spans = [tuple(map(int, s.split("-"))) for s in got[i].lines_removed.split(",") if s]
        numbers = {k for a, b in spans for k in range(a, b + 1)}
        lines = (text or "").split("\n")
        assert numbers == cuts[i] and got[i].doc_id == doc_id and got[i].n_lines == len(lines)
        assert got[i].words_removed == sum(len(brute.words_of(lines[k])) for k in numbers)


@pytest.mark.parametrize("seed", range(6))
def test_windows_cover_any_run_and_depend_on_it_alone(seed):
    rng = random.Random(seed)
    words = [rng.choice([1, 2, 5, 20, 49, 50, 80]) for _ in range(30)]
    found = linededup.windows(np.array(words), 50)
    assert found == sorted(
        (a, b) for a in range(30) for b in range(a + 1, 31)
        if sum(words[a:b]) >= 50 and (sum(words[a : b - 1]) < 50 or sum(words[a + 1 : b]) < 50)
    )
    for a in range(30):
        for b in range(a + 1, 31):
            if sum(words[a:b]) >= 50:
                within = [(x, y) for x, y in found if a <= x and y <= b]
                assert {i for x, y in within for i in range(x, y)} == set(range(a, b))
                assert [(x - a, y - a) for x, y in within] == linededup.windows(np.array(words[a:b]), 50)


@pytest.mark.parametrize("seed", range(6))
def test_minima_are_those_of_every_window_and_few(seed):
    rng = random.Random(seed)
    hashes = [rng.randrange(20) if seed % 2 else rng.getrandbits(60) for _ in range(400)]
    spans = linededup.windows(np.full(400, 5), 50)
    chosen = linededup.minima(hashes, spans)
    want = {max(i for i in range(a, b) if hashes[i] == min(hashes[a:b])) for a, b in spans}
    assert set(chosen) == want and len(chosen) < 130  # of 400; ten lines a window
    shared = hashes[100:160]
    other = [rng.getrandbits(60) for _ in range(70)] + shared
    theirs = {other[i] for i in linededup.minima(other, linededup.windows(np.full(130, 5), 50))}
    for a, b in linededup.windows(np.full(60, 5), 50):
        assert min(shared[a:b]) in theirs & {hashes[i] for i in chosen}


def test_texts_without_repeats_make_no_window_rows(spark):
    rng = random.Random(3)
    short = "\n".join(f"w{rng.getrandbits(40)}" for _ in range(4000))  # one word a line
    rows = [(1, short), (2, "\n".join(f"v{rng.getrandbits(40)}" for _ in range(4000)))]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("row", F.monotonically_increasing_id())
    lines = linededup.line_table(docs, "row", "doc_id", "text", 50)
    assert linededup.repeats(lines, 50).count() == 0
    kept = lines.agg(F.sum(8 * F.size("chosen")), F.sum(8 * F.size("hashes"))).first()
    assert kept[0] < 0.1 * 2 * len(short) and kept[1] < 2 * 2 * len(short)


def test_every_line_survives_somewhere(spark):
    rows = documents(5)
    kept = linededup.dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    lines = lambda texts: {x.strip() for t in texts if t for x in t.split("\n")} - {""}
    assert lines(r.text for r in kept) == lines(t for _, t in rows)


def test_empty(spark):
    assert linededup.dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_runs_are_cut_whole_though_the_first_place_goes_on_otherwise(spark):
    window, tail = " ".join(f"w{k}" for k in range(60)), "t1 t2\nt3 t4"
    by_hand = [(1, window), (2, f"{window}\n{tail}\nx"), (3, f"y\n{window}\n{tail}\nz"), (4, f"{window}\nt1 t2\nv")]
    got = {r.doc_id: r.text for r in linededup.dedup(spark.createDataFrame(by_hand, SCHEMA)).collect()}
    assert got == {1: window, 2: f"{tail}\nx", 3: "y\nz", 4: "v"}


def test_the_pipeline_cuts_whole_runs(spark):
    import corpus_pipeline

    window, tail = " ".join(f"w{k}" for k in range(60)), "t1 t2 t3"
    rows = [(1, window, 1), (2, f"{window}\n{tail}\nx", 1), (3, f"{window}\n{tail}\nz", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    kept = corpus_pipeline.cut_repeated_lines(spark, docs, "").collect()
    assert {r.doc_id: r.text for r in kept} == {1: window, 2: f"{tail}\nx", 3: "z"}
