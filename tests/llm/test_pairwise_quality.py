import zlib

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from larder.llm import quality as q
from larder.llm.common import read

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def documents(spark):
    return read(spark, SF.replace("sf0.001", "sf0.01"), "documents")


@pytest.fixture(scope="module")
def labels(spark):
    return read(spark, SF.replace("sf0.001", "sf0.01"), "labels")


def test_held_out_accuracy(spark, documents, labels):
    model = q.train(documents, labels)
    rows = documents.select("doc_id", q.score(documents, model).alias("s")).join(labels, "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % q.FOLDS == 0]
    assert len(held) > 50
    assert np.mean([(r.s >= q.CUT) == (r.quality == 1) for r in held]) > 0.95
    assert all(0 <= r.s <= 1 for r in rows)


def test_learns_from_its_own_folds_only(spark, documents, labels):
    fold = F.crc32(F.col("doc_id").cast("string")) % q.FOLDS
    flipped = labels.withColumn("quality", F.when(fold == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = q.train(documents, labels), q.train(documents.repartition(5), flipped)
    assert all(np.array_equal(x, y) for x, y in zip(a, b))


def test_preferences_are_learned_and_cut_at_their_quantile():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, q.FEATURES))
    preferred = x[:, 2] - x[:, 5] > -0.8
    model = q.fit(x, preferred)
    assert model.weights[2] > 0 > model.weights[5]
    assert abs((model.score(x) >= q.CUT).mean() - preferred.mean()) < 0.01
    assert ((model.score(x) >= q.CUT) == preferred).mean() > 0.97
    difference = x[0] - x[1]
    gap = model.preference(x[:1]) - model.preference(x[1:2])
    assert gap == pytest.approx((difference / model.scale) @ model.weights)


def test_odd_rows(spark, labels):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "word " * 60_000), (None, "A few words."), (4, "x"), (4, "x")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"_score": F.lit("s"), "quality": F.lit(9), "x": F.lit(1)})
    marks = spark.createDataFrame(
        [(1, 1, 0), (4, 0, 0), (2, 1, 0), (3, 1, 0), (3, 0, 0), (None, 1, 0), (5, None, 0), (6, 7, 0)],
        "doc_id long, quality int, toxic int",
    )
    for some in (marks, marks.limit(0), marks.filter("quality = 1")):
        model = q.train(df, some)
        scores = [r.s for r in df.select(q.score(df, model).alias("s")).collect()]
        assert len(scores) == len(rows) and all(0 <= s <= 1 for s in scores)
        kept = q.keep_good(df, some)
        assert kept.columns == df.columns
        assert {1, 2, 3} <= {r.doc_id for r in kept.collect()}  # nothing to judge them by
    assert q.keep_good(df.limit(0), marks).count() == 0


def test_features_of_long_and_odd_texts():
    for text in ("", " ", "\n\n", "é" * 10, "a" * 10**6, "|" * 50, "\0"):
        values = q.features(text.encode())
        assert len(values) == q.FEATURES and np.isfinite(values).all()


def test_every_labelled_row_is_learned_from(spark, documents, labels, monkeypatch):
    """Over several blocks: moments and threshold are those of all rows, and all rows are paired."""
    rows = q.labelled(documents, labels, "text").collect()
    x, preferred = np.array([r.x for r in rows]), np.array([r.quality == 1 for r in rows])
    whole = q.fit(x, preferred)
    monkeypatch.setattr(q, "BLOCK", 16)
    model = q.train(documents, labels)
    assert model.mean == pytest.approx(x.mean(axis=0)) and model.scale == pytest.approx(x.std(axis=0) + 1e-3)
    assert ((model.score(x) >= q.CUT) == preferred).mean() > 0.95
    assert abs((model.score(x) >= q.CUT).mean() - preferred.mean()) < 1.5 / len(x)
    assert np.corrcoef(model.preference(x), whole.preference(x))[0, 1] > 0.98
    _, pairs, counts = q._deal(q.labelled(documents, labels, "text").withColumn("key", F.xxhash64("doc_id", "x")))
    often = "good" if counts[1] > counts[0] else "bad"
    assert pairs.count() > 3
    assert pairs.agg(F.sum(F.size(often))).first()[0] == max(counts.values())


def test_no_label_is_left_out_beyond_a_number(spark):
    """10,000 labelled rows, of which the last by any order of hashes still count."""
    ids = spark.range(10_000).withColumnRenamed("id", "doc_id")
    text = F.concat(F.lit("word "), F.repeat(F.lit("| "), (F.col("doc_id") % 97).cast("int")))
    docs = ids.withColumn("text", text)
    marks = ids.withColumn("quality", (F.col("doc_id") % 97 < 30).cast("int"))
    learned = q.labelled(docs, marks, "text").count()
    assert learned == sum(zlib.crc32(str(i).encode()) % q.FOLDS != 0 for i in range(10_000)) > 6000
    model = q.train(docs, marks)
    x = np.array([q.features(("word " + "| " * (i % 97)).encode()) for i in range(10_000) if zlib.crc32(str(i).encode()) % q.FOLDS])
    assert model.mean == pytest.approx(x.mean(axis=0))
