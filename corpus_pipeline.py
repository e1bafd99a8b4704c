"""A corpus made ready for training, stage by stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import decontaminate, linededup, mix, quality, simhash
from larder.llm.common import read
from larder.sources.tables import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of passages are cut; a document made of nothing else goes."""
    kept = linededup.dedup(docs)
    nothing_left = (F.col("words_removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return kept.filter(~nothing_left).select(
        *[
            F.when(F.col("words_removed") > 0, F.length("text")).otherwise(F.col(c)).alias(c)
            if c == "n_chars"
            else F.col(c)
            for c in docs.columns
        ]
    )


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.clean_documents(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares; a row for each time a document is taken."""
    return mix.mix(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_good),
    ("lines", cut_repeated_lines),
    ("simhash", keep_one_of_each),
    ("benchmark", drop_contaminated),
    ("mix", mix_sources),
]

# The classifier's weights are learned, so SQL can't state which documents it keeps.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written and read by the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
