import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from larder.llm import langid as li
from larder.llm.common import read


@pytest.fixture(scope="module")
def documents(spark):
    return read(spark, SF.replace("sf0.001", "sf0.01"), "documents")


@pytest.fixture(scope="module")
def model(documents):
    return li.train(documents)


def segmentations(word):
    if not word:
        yield ()
    for i in range(1, len(word) + 1):
        for rest in segmentations(word[i:]):
            yield (word[:i], *rest)


def test_forward_sum_is_over_all_segmentations():
    pieces = ["▁", "▁t", "t", "h", "e", "th", "he", "▁the", "é"]
    counts = {"x": Counter({"the": 5, "teeth": 2, "hé": 1}), "y": Counter({"het": 4, "the": 1})}
    model = li.learn(counts, pieces)
    hashes = dict(zip(pieces, li.hash_pieces(pieces).tolist()))
    row = {p: model.hashes.tolist().index(h) for p, h in hashes.items()}
    words = ["the", "teeth", "thé", "xyz", "h"]
    got = np.exp(li.word_logs(words, model, li.Table(model.hashes)))
    for word, sums in zip(words, got):
        want = np.zeros(2)
        for parts in segmentations("▁" + word):
            known = [row.get(p, len(pieces) if len(p) == 1 else None) for p in parts]
            if None not in known:
                want += np.exp(model.logs[known].sum(axis=0))
        assert sums == pytest.approx(want, rel=1e-9)


def test_learning_raises_the_likelihood():
    pieces = li.read_pieces()
    counts = {"en": Counter({"the": 50, "there": 9, "other": 8, "thing": 7}), "de": Counter({"der": 40, "wieder": 9})}
    table = None
    logs = []
    for rounds in (1, 2, 5):
        model = li.learn(counts, pieces, rounds)
        table = li.Table(model.hashes)
        word_logs = li.word_logs(list(counts["en"]), model, table)
        logs.append(sum(n * x for n, x in zip(counts["en"].values(), word_logs[:, model.languages.index("en")])))
    assert logs == sorted(logs)
    assert np.exp(model.logs).sum(axis=0) == pytest.approx([1, 1])


def test_table_finds_what_is_there():
    rng = np.random.default_rng(1)
    keys = rng.integers(1, 1 << 63, 5000, dtype=np.uint64)
    keys[:50] = (keys[:50] & ~np.uint64(0x3FFFF)) | np.uint64(7)  # clashes
    keys = np.unique(keys)
    table = li.Table(keys)
    assert (table.find(keys.copy()) == np.arange(len(keys))).all()
    assert (table.find(rng.integers(1, 1 << 63, 5000, dtype=np.uint64)) == len(keys)).all()


def test_held_out_accuracy(documents, model):
    rows = documents.select("doc_id", "lang", li.identify(documents, model).alias("f")).collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % li.FOLDS == li.HELD_OUT]
    assert len(held) > 150
    assert np.mean([r.f.lang_pred == r.lang for r in held]) > 0.97
    assert all(0 <= r.f.score <= 1 for r in rows)


def test_learns_from_its_own_folds_only(documents):
    fold = F.crc32(F.col("doc_id").cast("string")) % li.FOLDS
    wrong = documents.withColumn("lang", F.when(fold == li.HELD_OUT, F.lit("xx")).otherwise(F.col("lang")))
    assert li.training_words(wrong) == li.training_words(documents)


def test_odd_rows(spark, model):
    rows = [
        (1, None, "und"), (2, "", "und"), (3, "123 ²½ !?", "und"), (4, "The " * 100_000, "en"), (5, "x" * 50_000, None),
        (None, "der und die mit von", "de"), (6, "漢字 العربية", None), (7, "1a", None), (7, "1a", None),
    ]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    df = df.withColumns({"lang": F.lit("en"), "words": F.lit(1), "lang_pred": F.lit(2)})
    got = [r.f for r in df.select(li.identify(df, model).alias("f")).collect()]
    for (_, _, want), f in zip(rows, got):
        assert 0 <= f.score <= 1 and f.lang_pred in (*model.languages, "und")
        assert f.lang_pred == want if want else f.lang_pred in model.languages
    assert df.limit(0).select(li.identify(df, model)).count() == 0
    for none in (df.limit(0), df.withColumn("lang", F.lit(None).cast("string"))):
        assert {r.f.lang_pred for r in df.select(li.identify(df, li.train(none)).alias("f")).collect()} == {"und"}
