import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larder.llm import queries, superminhash

SCHEMA = "doc_id long, text string"


def set_of(text):
    """The shingles themselves, by hand."""
    text = "".join(c.lower() if c.isascii() else c for c in text or "")
    words, word = [], ""
    for c in text + " ":
        if c == " " or "\x09" <= c <= "\x0d":
            words, word = words + [word] if word else words, ""
        else:
            word += c
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2)))


def slow(rows, threshold=85):
    """doc_id, size, component and kept, comparing all pairs of different sets."""
    sets = [set_of(text) for _, text in rows]
    distinct = sorted({s for s in sets if s}, key=len)
    parent = {s: s for s in distinct}

    def root(s):
        while parent[s] != s:
            s = parent[s]
        return s

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if 100 * len(a) < threshold * len(b):
                break
            if 100 * len(a & b) >= threshold * len(a | b):
                parent[root(a)] = root(b)
    least = defaultdict(list)
    for (doc_id, _), s in zip(rows, sets):
        if s and doc_id is not None:
            least[root(s)].append(doc_id)
    found = []
    for (doc_id, _), s in zip(rows, sets):
        component = (min(least[root(s)]) if least[root(s)] else None) if s else doc_id
        found.append((doc_id, len(s), component, doc_id == component))
    return sorted(found, key=str)


def result(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aAbBéÉ \t\n\x0b\x1c\xa0", max_size=60))
def test_shingles_by_hand(text):
    assert len(superminhash.shingles(text.encode())) == len(set_of(text))


def one_by_one(elements, length):
    """The published loop: elements in turn, each with the shuffle of its own, no early stop."""
    best = [float("inf")] * length
    for element in elements:
        order = list(range(length))
        for rank in range(length):
            drawn = superminhash._mixed(np.array([element], np.uint64), rank)
            fraction = int(drawn[0] >> np.uint64(11)) * 2.0**-53
            other = int(superminhash._mixed(drawn, rank + length)[0]) >> 32
            swap = rank + other % (length - rank)
            order[rank], order[swap] = order[swap], order[rank]
            best[order[rank]] = min(best[order[rank]], rank + fraction)
    return best


@pytest.mark.parametrize("n,length", [(1, 8), (3, 8), (40, 8), (200, 8), (5, 16), (300, 2)])
def test_signature_is_that_of_the_plain_loop(n, length, monkeypatch):
    monkeypatch.setattr(superminhash, "PIECE", 64)
    rng = np.random.default_rng(n)
    elements = rng.integers(0, 1 << 63, n).astype(np.uint64)
    found = superminhash.superminhash(elements, length)
    assert found.tolist() == one_by_one(elements, length)
    assert superminhash.superminhash(elements[::-1].copy(), length).tolist() == found.tolist()


def test_one_element_has_every_rank():
    found = superminhash.superminhash(np.array([7], np.uint64), 32)
    assert sorted(np.floor(found).tolist()) == list(range(32))


def test_variance_is_below_that_of_independent_hashes():
    rng = np.random.default_rng(0)
    length, similarity, estimates = 160, 0.5, []
    for _ in range(400):
        pool = rng.integers(0, 1 << 63, 90).astype(np.uint64)
        a, b = (superminhash.superminhash(p, length) for p in (pool[:60], pool[15:75]))
        estimates.append((a == b).mean())
    expected = 45 / 75
    assert abs(np.mean(estimates) - expected) < 0.01
    assert np.var(estimates) < 0.9 * expected * (1 - expected) / length


def varied(rng, n, clusters, words=60):
    """Texts around a few centres, with similarities on both sides of the threshold."""
    vocabulary = [f"w{i}" for i in range(500)]
    texts = []
    for _ in range(clusters):
        centre = [rng.choice(vocabulary) for _ in range(words)]
        for _ in range(n // clusters):
            text = list(centre)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            if rng.random() < 0.2:
                centre = text
            texts.append(" ".join(text).title() if rng.random() < 0.3 else " ".join(text))
    return texts


@pytest.mark.parametrize("bounds", [{}, {"most_in_bucket": 8, "most_shingles": 600}])
def test_components_equal_those_of_all_pairs(spark, bounds):
    rng = random.Random(6)
    texts = varied(rng, 400, 8) + varied(rng, 60, 20, 9) + ["a b c d"] * 30 + ["A  B\nC d"] * 5
    rows = [(i, text) for i, text in enumerate(texts)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert result(superminhash.near_duplicates(df, **bounds)) == slow(rows)


def test_odd_rows(spark):
    rows = [
        (1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "One"), (6, "one two"), (7, "two one"),
        (8, "one two three"), (8, "one two three"), (9, "one two three"), (None, "one two three"),
        (None, "nobody has this"), (None, None), (10, "x " * 200_000), (11, "x " * 90_000),
        (12, "É É É É"), (13, "é é é é"), (8, "another text with this id"),
    ]
    df = spark.createDataFrame([(*r, b"k", 1) for r in rows], SCHEMA + ", key binary, cluster int")
    assert result(superminhash.near_duplicates(df)) == slow(rows)


def test_a_long_text_and_its_near_copy(spark):
    rng = random.Random(8)
    words = [f"w{rng.randrange(10**6)}" for _ in range(60_000)]
    other = [w if rng.random() > 0.02 else "changed" for w in words]
    rows = [(2, " ".join(words)), (1, " ".join(other)), (3, " ".join(words[:48_000]))]
    assert result(superminhash.near_duplicates(spark.createDataFrame(rows, SCHEMA))) == slow(rows)


def test_no_rows(spark):
    assert superminhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query(spark, sf="/root/testdata/sf0.001"):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert result(queries.op13_shingle_components(spark, sf)) == slow(rows)
