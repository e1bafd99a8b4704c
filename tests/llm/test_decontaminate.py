import random

import brute
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larder.llm import decontaminate as d

SCHEMA = "doc_id long, text string"


def made(seed=1):
    rng = random.Random(seed)
    word = lambda: rng.choice("the of and cat dog run ÉCOLE école 42 x1 Zug".split())
    items = [(i, " ".join(word() for _ in range(rng.choice([3, 9, 10, 11, 25])))) for i in range(25)]
    items += [(None, items[3][1]), (3, items[4][1]), (90, None), (91, ""), (92, "!?"), (93, "run-42")]
    docs = []
    for i in range(80):
        parts = [word() for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 2)):
            piece = rng.choice(items[:25])[1].split(" ")
            low = rng.randint(0, 2)
            at = rng.randint(0, len(parts))
            parts[at:at] = [w.upper() + rng.choice(["", ",", "_"]) for w in piece[low:]]
        docs.append((i, rng.choice([" ", "\n", " - "]).join(parts)))
    docs += [(200, None), (201, ""), (202, "... ---"), (None, items[0][1]), docs[4], docs[4]]
    return docs, items


def test_same_as_by_hand(spark):
    docs, items = made()
    df, bench = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    for how in ({}, {"most_words": 40}):  # in one broadcast, and in several blocks
        got = df.select("doc_id", "text", d.hits(df, bench, **how).alias("h")).collect()
        assert any(r.h.n_hit for r in got) and any(not r.h.n_hit for r in got)
        for r in got:
            words, hit, found = brute.hits(r.text, items)
            assert (r.h.n_words, r.h.n_hit, r.h["items"]) == (len(words), len(hit), found)
            assert {k for s in r.h.spans for k in range(s.a, s.b + 1)} == hit


def test_documents_and_spans_go(spark):
    docs, items = made(2)
    df = spark.createDataFrame(docs, SCHEMA).withColumns({"_hits": F.lit(1), "n_hit": F.lit(2)})
    bench = spark.createDataFrame(items, "item_id long, text string")
    kept = d.clean_documents(df, bench)
    assert kept.columns == df.columns
    want = [t for _, t in docs if not brute.hits(t, items)[1]]
    assert sorted(map(str, (r.text for r in kept.collect()))) == sorted(map(str, want))
    for r in d.clean_spans(df.filter("doc_id is not null"), bench).collect():
        old = dict(docs)[r.doc_id]
        words, hit, _ = brute.hits(old, items)
        assert brute.folded_words(r.text) == [w for i, w in enumerate(words) if i not in hit]
        assert hit or r.text == old


def test_empty_tables(spark):
    docs, items = made()
    df, none = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([], "item_id long, text string")
    assert d.clean_documents(df, none).count() == len(docs)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert d.clean_documents(df.limit(0), bench).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=40))
def test_words(text):
    assert [w.decode() for w in d.words_of(text.encode("utf-8", "replace"))] == brute.folded_words(
        text.encode("utf-8", "replace").decode()
    )
    assert [m.group() for m in d.WORD.finditer(text)] == [
        w for w in d.WORD.findall(text)
    ] and len(d.WORD.findall(text)) == len(brute.folded_words(text))
