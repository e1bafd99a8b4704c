import random

import brute
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larder.llm import simhash
from larder.llm.components import components

SCHEMA = "doc_id long, text string"


def signed(p):
    return p - (1 << 64) if p >> 63 else p


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="aAbBcCéÉ \t\n\x0b\x1c ", max_size=60))
def test_fingerprint_by_hand(text):
    assert simhash.fingerprint(text.encode()) % (1 << 64) == brute.fingerprint(text)


def test_fingerprint_of_a_long_text():
    rng = random.Random(2)
    text = " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(70_000))
    assert simhash.fingerprint(text.encode()) % (1 << 64) == brute.fingerprint(text)


def close_prints(n, seed):
    """Random fingerprints, and clusters around some of them."""
    rng = random.Random(seed)
    prints = {rng.getrandbits(64) for _ in range(n)} | {0, (1 << 64) - 1, 15, 31}
    for centre in list(prints)[:12]:
        p = centre
        for _ in range(12):
            q = p
            for bit in rng.sample(range(64), rng.randint(1, 6)):
                q ^= 1 << bit
            prints.add(q)
            p = rng.choice([centre, q])
    return sorted(prints)


def check_links(spark, prints):
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    edges = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(df).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in edges)
    roots = {r.node % (1 << 64): r.root % (1 << 64) for r in components(simhash.links(df)).collect()}
    got = [roots.get(p, p) for p in prints]
    groups = lambda labels: sorted(
        tuple(i for i, x in enumerate(labels) if x == label) for label in set(labels)
    )
    assert groups(got) == groups(brute.components(range(len(prints)), prints))


def test_links_join_the_same_components_as_all_pairs(spark):
    check_links(spark, close_prints(300, 3))


def test_links_of_crowded_cells_are_whole(spark, monkeypatch):
    monkeypatch.setattr(simhash, "MOST_IN_RUN", 12)
    check_links(spark, close_prints(300, 4) + list(range(100, 180)))


def test_embedding_bounds_the_distance_from_below(spark):
    prints = close_prints(50, 5)
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    points = [r[0] % (1 << 64) for r in df.select(simhash.embedding(F.col("fp"))).collect()]
    count = lambda p: [(p >> (2 * s) & 1) + (p >> (2 * s + 1) & 1) for s in range(32)]
    for a, x in zip(prints, points):
        for b, y in zip(prints, points):
            apart = sum(abs(i - j) for i, j in zip(count(a), count(b)))
            assert (x ^ y).bit_count() == apart <= (a ^ b).bit_count()


def documents():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    base = [" ".join(word() for _ in range(400)) for _ in range(12)]
    near = []
    for text in base[:6]:
        parts = text.split(" ")
        parts[rng.randrange(len(parts))] = "zzzz"
        near.append(" ".join(parts))
    texts = base + near + [base[0].upper(), None, "", "  ", "one", "one two", "one  two"]
    rows = [(100 - i, t) for i, t in enumerate(texts)]
    return rows + [(None, base[1]), (None, "only here"), rows[2], rows[2]]


def test_near_duplicates_by_hand(spark):
    rows = documents()
    prints = [brute.fingerprint(t) for _, t in rows]
    want = zip([r[0] for r in rows], prints, brute.components([r[0] for r in rows], prints))
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("fp", "root", "least")})
    got = simhash.near_duplicates(df).collect()
    assert sorted(map(str, ((r[0], r[1], r[2]) for r in got))) == sorted(
        str((i, f"{p:016x}", c)) for i, p, c in want
    )


def test_one_of_each_group_stays(spark):
    rows = documents()
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(c) for c in ("_row", "_fp", "best")})
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    prints = [brute.fingerprint(t) for _, t in rows]
    groups = {}
    for (i, t), c in zip(rows, brute.components(range(len(rows)), prints)):
        groups.setdefault(c, []).append((i is None, i, t))
    got = [(r.doc_id is None, r.doc_id, r.text) for r in kept.collect()]
    assert len(got) == len(groups)
    for members in groups.values():
        assert sum((m[0], m[1]) == min((x[:2] for x in members), key=lambda x: (x[0], x[1] or 0))
                   for m in got if m in members) == 1


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0
