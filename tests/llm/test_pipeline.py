import brute
import corpus_pipeline
import pytest
from conftest import SF
from pyspark.sql import functions as F

from larder.llm import quality
from larder.llm.common import read

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The test tables, with odd rows among the documents."""
    at = str(tmp_path_factory.mktemp("tables"))
    docs = read(spark, SF, "documents")
    passage = "\n".join(" ".join(f"k{i}x{j}" for j in range(11)) for i in range(6))
    odd = [
        (9001, None, "en", "src1", None),
        (9002, "", "en", None, 0),
        (9003, passage + "\nFirst end of it.", None, "src1", 1),
        (9004, "Another begin.\n" + passage, "en", "src2", 1),
        (9005, passage, "en", "src2", 1),
        (9006, " ", "en", "src2", 1),
    ]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    docs.coalesce(1).write.parquet(f"{at}/documents.parquet")
    for name in ("benchmark", "labels"):
        read(spark, SF, name).write.parquet(f"{at}/{name}.parquet")
    return at


def slow(spark, folder):
    docs = [tuple(r) for r in read(spark, folder, "documents").select(*COLUMNS).collect()]
    model = quality.train(read(spark, folder, "documents"), read(spark, folder, "labels"))
    good = lambda t: not brute.words_of(t) or (
        model.score(quality.np.array([quality.features(t.encode())]))[0] >= quality.CUT
    )
    docs = [r for r in docs if good(r[1])]
    docs.sort(key=lambda r: r[0])
    cuts = brute.repeated_lines([r[1] for r in docs])
    kept = []
    for r, cut in zip(docs, cuts):
        text = brute.without_lines(r[1], cut) if cut else r[1]
        if not cut:
            kept.append(r)
        elif brute.words_of(text):
            kept.append((r[0], text, r[2], r[3], len(text)))
    labels = brute.components([r[0] for r in kept], [brute.fingerprint(r[1]) for r in kept])
    kept = [r for r, least in zip(kept, labels) if r[0] == least]
    items = [tuple(r) for r in read(spark, folder, "benchmark").select("item_id", "text").collect()]
    kept = [r for r in kept if not brute.hits(r[1], items)[1]]
    return [(*r, n) for r, c in zip(kept, brute.mix([(r[0], r[1], r[3]) for r in kept])) for n in range(1, c + 1)]


def test_same_as_the_slow_version(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == [*COLUMNS, "copy"]
    want = slow(spark, folder)
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))
    assert len({r[0] for r in want}) > 80


def test_stages(spark, folder):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "lines", "simhash", "benchmark", "mix"]
    docs = read(spark, folder, "documents").withColumn("extra", F.lit("x"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, folder)
        assert after.columns == docs.columns and after.dtypes == docs.dtypes
        assert 0 < after.count() <= docs.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0
