"""One query per operator, over whole tables, and the same results in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import (
    ann,
    decontaminate,
    langid,
    linededup,
    mix,
    pii,
    quality,
    repair,
    secretscan,
    simhash,
    superminhash,
    tokalign,
    warc,
)
from larder.llm.common import read, remainder


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.shares(read(spark, sf_dir, "documents"))


def _written(spans: str) -> Column:
    """Spans as kind:start:end, comma-joined."""
    parts = F.transform(F.col(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    return F.array_join(parts, ",")


def _count(spans: str, kind: str) -> Column:
    return F.size(F.filter(F.col(spans), lambda s: s["kind"] == kind)).cast("long")


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = pii.find(docs, pii.train(docs))
    order = {kind: i for i, kind in enumerate(pii.KINDS)}
    rank = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    together = F.array_sort(
        F.transform(
            F.concat("found.base", "found.more"),
            lambda s: F.struct(rank[s["kind"]].alias("order"), s["start"], s["end"], s["kind"]),
        )
    )
    return (
        docs.select("doc_id", found.alias("found"))
        .select("doc_id", F.col("found.base").alias("base"), together.alias("everything"))
        .select(
            "doc_id",
            *[_count("base", kind).alias(f"n_{kind}") for kind in pii.KINDS],
            F.sha2(_written("base"), 256).alias("base_sha256"),
            _written("everything").alias("spans"),
        )
    )


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = decontaminate.hits(docs, read(spark, sf_dir, "benchmark"))
    return docs.select("doc_id", found.alias("found")).select(
        "doc_id",
        "found.n_words",
        "found.n_hit",
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"),
        (F.col("found.n_hit") > 0).alias("contaminated"),
    )


def op4_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    return docs.select(
        "doc_id",
        (remainder(F.col("doc_id"), quality.FOLDS) == 0).alias("held_out"),
        quality.score(docs, model).alias("score"),
    ).withColumn("predicted", (F.col("score") >= quality.CUT).cast("int"))


def op5_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(read(spark, sf_dir, "pages"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return (
        docs.select("doc_id", secretscan.find(docs).alias("found"))
        .select("doc_id", F.col("found.base").alias("base"), F.col("found.all").alias("everything"))
        .select(
            "doc_id",
            *[_count("base", kind).alias(f"n_{kind}") for kind in secretscan.KINDS],
            F.sha2(_written("base"), 256).alias("base_sha256"),
            _written("everything").alias("spans"),
        )
    )


def op7_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op9_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.removals(
        docs.withColumn("row", F.monotonically_increasing_id()), "row"
    ).drop("row")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = langid.train(docs)
    return docs.select(
        "doc_id",
        (remainder(F.col("doc_id"), langid.FOLDS) == langid.HELD_OUT).alias("held_out"),
        langid.identify(docs, model).alias("found"),
    ).select("doc_id", "held_out", "found.*")


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with faults put in by the hash of a row's conversation and turn."""
    space = F.lit(" ")
    key = [F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")]
    fault = F.crc32(F.concat(key[0], F.lit(":"), key[1])) % 20
    role, text = (F.coalesce(c, space) for c in ("role", "text"))
    changed = turns.select(
        "conv_id",
        "turn",
        F.when(fault == 4, "user").otherwise(role).alias("role"),
        F.when(fault == 1, "")
        .when(fault == 2, F.regexp_replace(text, "[.!?]", ""))
        .otherwise(text)
        .alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"),
    )
    copy = F.explode(F.array_repeat(F.lit(0), F.col("copies")))
    return changed.withColumn("copy", copy).drop("copy", "copies")


def op11_repaired_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    rows = damaged(turns)
    found = repair.audits(rows)
    every = turns.select(F.col("conv_id").alias("id")).distinct()
    heads = every.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("id").alias("conv_id"),
        *[F.coalesce(f, F.lit(0)).cast("long").alias(f) for f in repair.FIGURES],
        F.coalesce("audit", F.lit("")).alias("audit"),
    )
    return repair.digests(rows, heads)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tokalign.alignments(read(spark, sf_dir, "documents"), keep_groups=False)
    return found.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )


def op13_shingle_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_duplicates(read(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_pareto_mix,
        op2_personal_data,
        op3_decontaminate,
        op4_pairwise_quality,
        op5_warc_derivatives,
        op6_secrets,
        op7_nearest_vectors,
        op8_simhash_components,
        op9_repeated_lines,
        op10_language,
        op11_repaired_conversations,
        op12_token_alignment,
        op13_shingle_components,
    )
}
