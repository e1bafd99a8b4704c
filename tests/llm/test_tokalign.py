import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larder.llm import queries, tokalign


@pytest.fixture(scope="module")
def aligner():
    return tokalign.Aligner(tokalign.byte_tokenizer(), tokalign.piece_tokenizer())


@settings(max_examples=300, deadline=None)
@given(st.sets(st.integers(0, 3000)), st.sets(st.integers(0, 3000), min_size=1))
def test_gallop_finds_every_place(a, b):
    short, long_ = np.array(sorted(a), np.int64), np.array(sorted(b), np.int64)
    assert tokalign.gallop(short, long_).tolist() == np.searchsorted(long_, short).tolist()


def test_gallop_over_long_gaps():
    rng = random.Random(3)
    long_ = np.array(sorted(rng.sample(range(10**7), 200_000)))
    short = np.array(sorted(rng.sample(range(10**7), 500) + long_[:300].tolist()))
    assert tokalign.gallop(short, long_).tolist() == np.searchsorted(long_, short).tolist()


def by_hand(aligner, text):
    """Ids, groups and links of one text, token by token."""
    if not text:
        return [], [], [], []
    whole = (" " + text).encode()
    ids_a, ids_b = aligner.a.encode([" " + text])[0], aligner.b.encode([text])[0]
    ranges = []
    for ids, pieces in ((ids_a, aligner.a.pieces), (ids_b, aligner.b.pieces)):
        if b"".join(pieces[i] for i in ids) != whole:
            return [], [], [], []
        at, found = 0, []
        for i in ids:
            found.append((at, at + len(pieces[i]), i))
            at += len(pieces[i])
        ranges.append(found)
    a, b = ranges
    links, j = [], 0
    for start, end, i in a:
        while b[j][1] <= start:
            j += 1
        k = j
        while k < len(b) and b[k][0] < end:
            links.append((i, b[k][2]))
            k += 1
    groups = []
    for end in sorted({e for _, e, _ in a} & {e for _, e, _ in b}):
        sides = []
        for tokens in (a, b):
            side = []
            while tokens and tokens[0][1] <= end:
                side.append(str(tokens.pop(0)[2]))
            sides.append(",".join(side))
        groups.append("|".join(sides))
    return ids_a, ids_b, groups, links


def slow(aligner, rows):
    each = [(doc_id, *by_hand(aligner, text)) for doc_id, text in rows]
    count = Counter(link for *_, links in each for link in links)
    most = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    return sorted(
        (
            (doc_id, len(a), len(b), len(groups), len(links),
             hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "",
             sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links))
            for doc_id, a, b, groups, links in each
        ),
        key=str,
    )


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum")

ODD = [
    None, "", " ", "  ", "a", "Hello world", "Hello  world\n\n\tx", "▁", "a▁b", "<|endoftext|> and </s><s>",
    "<0x0A>", "\x00\x01", "é é ﬁ", "日本語のテキスト", "👩‍👩‍👧 emoji", "antidisestablishmentarianism",
    "x" * 5000, "naïve café " * 300, "1234567890 3.14159", "‮abc", "﻿bom",
]


@settings(max_examples=150, deadline=None)
@given(text=st.text(max_size=80) | st.text(alphabet="ab \n▁éxyz<>|0", max_size=80))
def test_any_text(aligner, text):
    ids_a, ids_b, groups, links = by_hand(aligner, text)
    (found,) = aligner([text])
    assert found.a.tolist() == ids_a and found.b.tolist() == ids_b
    assert tokalign.written(found, aligner.names) == ";".join(groups)
    pairs = [(p // tokalign.IDS, p % tokalign.IDS) for p in found.pairs.tolist()]
    assert sorted(pairs) == sorted(links)


def library_ids(texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokalign.BYTE_VOCABULARY)
    library.encode_special_tokens = True
    return [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=200) | st.text(alphabet="ab'st \n\t1É_-", max_size=200))
def test_both_byte_encoders_agree(aligner, text):
    assert aligner.a.encode([text]) == library_ids([text])


def test_both_byte_encoders_agree_on_strings_of_tokens(aligner):
    rng, texts = random.Random(7), []
    for _ in range(20_000):
        text = b"".join(rng.choice(aligner.a.pieces) for _ in range(rng.randint(1, 5)))
        texts.append(text.decode(errors="replace"))
    assert aligner.a.encode(texts) == library_ids(texts)


def test_long_runs_take_no_quadratic_time(aligner):
    texts = [" " + "ab" * 200_000, " " * 300_000, "a b " * 100_000, ""]
    assert [tokalign._longest_run(t) for t in texts] == [400_000, 300_000, 1, 0]
    assert aligner.a.encode(texts) == library_ids(texts)


@pytest.mark.parametrize("chunk", [40, tokalign.CHUNK])
def test_odd_texts(spark, aligner, chunk):
    rows = [(i, text) for i, text in enumerate(ODD)] + [(3, "Hello world"), (None, "Hello"), (None, None)]
    docs = spark.createDataFrame(
        [(*row, "x", "y") for row in rows], "doc_id long, text string, chunk string, pair string"
    )
    found = tokalign.alignments(docs.repartition(3), chunk=chunk)
    assert sorted(map(tuple, found.select(*COLUMNS).collect()), key=str) == slow(aligner, rows)
    assert found.filter("doc_id = 5").first()["groups"] == ";".join(by_hand(aligner, "Hello world")[2])


def test_special_strings_are_plain_text(aligner):
    (found,) = aligner(["<|endoftext|> </s>"])
    assert len(found.a) > 3 and 50256 not in found.a and 2 not in found.b


def test_no_rows(spark):
    assert tokalign.alignments(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query(spark, aligner, sf="/root/testdata/sf0.001"):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    found = queries.op12_token_alignment(spark, sf)
    assert sorted(map(tuple, found.select(*COLUMNS).collect()), key=str) == slow(aligner, rows)
