"""Quality scores learned from preference pairs: Bradley-Terry by logistic loss on differences."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import free_name, per_text, remainder
from larder.operators.quantile import quantile_values
from larder.sources.tables import materialize

UPPER = np.zeros(256, bool)
UPPER[65:91] = True
LOWER = np.zeros(256, bool)
LOWER[97:123] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
STOP = np.zeros(256, bool)
STOP[[33, 44, 46, 58, 59, 63]] = True  # ! , . : ; ?
MARK = np.zeros(256, bool)
MARK[33:128] = True
MARK &= ~(UPPER | LOWER | DIGIT | STOP)
FEATURES = 11
BLOCK = 4096  # labelled rows of one kind that a task pairs at once, about
ROUNDS = 8  # pairs of each row of the more frequent kind
FOLDS = 5
CUT = 0.3


def features(text: bytes) -> list[float]:
    """Shares that tell prose from junk, each from the whole text and from 0 to about 1."""
    words = text.split()
    if not words:
        return [0.0] * FEATURES
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    solid = counts[~SPACE].sum()
    n = len(words)
    lines = [line for line in text.split(b"\n") if line.strip()]
    repeated = sum(a == b for a, b in zip(words, words[1:])) / n
    letters = counts[UPPER | LOWER].sum() + 1
    return [
        counts[UPPER].sum() / letters,
        counts[MARK].sum() / solid,
        counts[33] / n,
        counts[124] / n,
        counts[DIGIT].sum() / solid,
        counts[STOP].sum() / n,
        repeated,
        1 - len(set(words)) / n if n > 1 else 0.0,
        1 - len(set(lines)) / len(lines),
        min(solid / n, 40.0) / 10,
        float(np.log1p(n)) / 10,
    ]


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float  # the score at the quantile that parts the learned labels

    def preference(self, x: np.ndarray) -> np.ndarray:
        """The Bradley-Terry scores: differences are the log odds of being preferred."""
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray, cut: float = CUT) -> np.ndarray:
        """Scores from 0 to 1; texts above the threshold's quantile get more than ``cut``."""
        log_odds = self.preference(x) - self.threshold + np.log(cut / (1 - cut))
        return 1 / (1 + np.exp(-np.clip(log_odds, -30, 30)))


def _differences(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Each row of the longer side less, or from, ``ROUNDS`` rows of the other, by fixed strides."""
    most = max(len(good), len(bad))
    first = np.tile(np.arange(most), ROUNDS)
    turn = np.repeat(np.arange(ROUNDS), most)
    # The larger side is walked through; the smaller is shifted by another stride each round.
    walk = lambda part, shift: part[(first + shift * turn * 7919) % len(part)]
    return walk(good, len(good) < len(bad)) - walk(bad, len(bad) <= len(good))


def _slopes(difference: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The number of pairs, and the sums of the loss's gradient and curvature over them."""
    p = 1 / (1 + np.exp(np.clip(difference @ weights, -30, 30)))
    curved = (difference * (p * (1 - p))[:, None]).T @ difference
    return np.concatenate([[len(p)], -(difference.T @ p), curved.ravel()])


def _newton(slopes: Callable[[np.ndarray], np.ndarray], ridge: float = 1e-2) -> np.ndarray:
    """The weights of least loss, log(1 + exp(-w . difference)) plus a ridge."""
    weights = np.zeros(FEATURES)
    for _ in range(25):
        sums = slopes(weights)
        means = sums[1:] / sums[0]
        gradient = ridge * weights + means[:FEATURES]
        curved = means[FEATURES:].reshape(FEATURES, FEATURES)
        step = np.linalg.solve(curved + ridge * np.eye(FEATURES), gradient)
        weights = weights - step
        if np.abs(step).max() < 1e-8:
            break
    return weights


def _cut_rank(rows: int, rejected: int) -> int:
    """How many of the ranked rows lie below the threshold."""
    return min(max(rejected, 1), rows - 1)


def fit(x: np.ndarray, preferred: np.ndarray) -> Model:
    """Learn from pairs of a preferred and another row; needs rows of both kinds.

    Each row of the more frequent kind is paired with ``ROUNDS`` rows of the other, by fixed
    strides, and the loss is minimised by Newton's method. For one block of rows;
    :func:`train` does the same over any number of blocks.
    """
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = np.clip((x - mean) / scale, -8, 8)
    difference = _differences(z[preferred], z[~preferred])
    weights = _newton(lambda w: _slopes(difference, w))
    ranked = np.sort(z @ weights)
    at = _cut_rank(len(ranked), int((~preferred).sum()))
    return Model(mean, scale, weights, float(ranked[at - 1 : at + 1].mean()))


def labelled(docs: DataFrame, labels: DataFrame, text: str) -> DataFrame:
    """Ids, labels and features of all learning rows.

    Rows of the held-out fold, without text, without label or with other labels than 0 and 1
    are left out, and so are ids whose labels disagree. Features are taken before the join, so it
    moves them and no texts.
    """
    fold = remainder(F.col("doc_id"), FOLDS)
    clear = (
        labels.select("doc_id", "quality")
        .filter((fold != 0) & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
        .filter("quality = other")
        .select("doc_id", "quality")
    )
    rows = docs.select("doc_id", F.col(text).alias("text")).filter((fold != 0) & F.col("text").isNotNull())
    return rows.select("doc_id", _features(F.col("text")).alias("x")).join(clear, "doc_id")


def _deal(rows: DataFrame) -> tuple[DataFrame, DataFrame, dict[int, int]] | None:
    """Learning rows in blocks of about ``BLOCK``, pairs of blocks, and the rows of each kind.

    Rows are dealt out by a hash, so a block is a random part of its kind whatever the order of
    the rows. Each block of the more frequent kind meets one block of the other. None if
    rows are not of both kinds.
    """
    found = rows.groupBy("quality").agg(
        F.count("*").alias("n"), F.countDistinct("key").alias("keys")
    )
    counts = {row["quality"]: (row["n"], row["keys"]) for row in found.collect()}
    if len(counts) < 2:
        return None
    often = int(counts[1][0] > counts[0][0])
    many = math.ceil(counts[often][0] / BLOCK)
    few = min(many, math.ceil(counts[1 - often][1] / BLOCK))  # by keys, so that none is empty
    blocks = F.when(F.col("quality") == often, many).otherwise(few)
    dealt = materialize(
        rows.groupBy("quality", F.pmod("key", blocks).alias("block")).agg(
            F.sort_array(F.collect_list("x")).alias("x")
        ),
        "blocks",
    )
    most = dealt.filter(F.col("quality") == often).select("block", F.col("x").alias("most"))
    least = dealt.filter(F.col("quality") != often).select(F.col("block").alias("other"), F.col("x").alias("least"))
    paired = most.join(least, F.pmod("block", F.lit(few)) == F.col("other")).select(
        "block",
        F.col("most" if often else "least").alias("good"),
        F.col("least" if often else "most").alias("bad"),
    )
    return dealt, materialize(paired, "pairs"), {k: n for k, (n, _) in counts.items()}


def _sums(blocks: DataFrame, order: Sequence[str], *columns: str, of: Callable[..., np.ndarray]) -> np.ndarray:
    """The sum of what ``of`` gives for each block's arrays, added up in a fixed order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [of(*arrays).tolist() for arrays in _arrays(batch, columns)]
            kept = [batch.column(c).cast(pa.int64()) for c in order]
            found = pa.array(sums, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*kept, found], names=[*order, "sums"])

    kinds = ", ".join(f"{c} long" for c in order)
    found = blocks.select(*order, *columns).mapInArrow(run, f"{kinds}, sums array<double>").collect()
    return np.sum([row["sums"] for row in sorted(found)], axis=0)


def _arrays(batch: pa.RecordBatch, columns: Sequence[str]) -> Iterator[list[np.ndarray]]:
    for i in range(batch.num_rows):
        values = (batch.column(c)[i].values.flatten() for c in columns)
        yield [v.to_numpy(zero_copy_only=False).reshape(-1, FEATURES) for v in values]


def _features(text: Column) -> Column:
    def compute(texts: list[bytes]) -> Iterable[tuple]:
        return ((features(t),) for t in texts)

    return per_text(compute, "x array<double>")(text)["x"]


def train(docs: DataFrame, labels: DataFrame, text: str = "text") -> Model | None:
    """A model from all labelled rows, or None if they are not of both kinds.

    The method of :func:`fit`, with each block's pairs added up in a task of its own: the driver
    gets sums, of which there are as many for a block as for a row's square. The threshold is the
    exact quantile of all learned rows. The model is the same however rows arrive.
    """
    learned = labelled(docs, labels, text).withColumn("key", F.xxhash64("doc_id", "x"))
    dealt = _deal(materialize(learned, "labelled"))
    if dealt is None:
        return None
    blocks, pairs, counts = dealt
    n, each = sum(counts.values()), ("quality", "block")
    mean = _sums(blocks, each, "x", of=lambda x: x.sum(axis=0)) / n
    scale = np.sqrt(_sums(blocks, each, "x", of=lambda x: ((x - mean) ** 2).sum(axis=0)) / n) + 1e-3

    def scaled(x: np.ndarray) -> np.ndarray:
        return np.clip((x - mean) / scale, -8, 8)

    weights = _newton(
        lambda w: _sums(
            pairs, ["block"], "good", "bad",
            of=lambda good, bad: _slopes(_differences(scaled(good), scaled(bad)), w),
        )
    )

    def preferences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (x,) in _arrays(batch, ["x"]):
                yield pa.RecordBatch.from_arrays([pa.array(scaled(x) @ weights)], names=["v"])

    ranked = materialize(blocks.select("x").mapInArrow(preferences, "v double"), "preferences")
    middle = (_cut_rank(n, counts[0]) - 0.5) / (n - 1)  # between the two rows around the cut
    threshold = quantile_values(ranked, "v", [middle])[0]
    return Model(mean, scale, weights, threshold)


def score(docs: DataFrame, model: Model | None, text: str = "text") -> Column:
    """A column with the score of ``text``: from 0 to 1, higher for better texts.

    Whole texts count, and nothing but the text. Null and empty texts are scored by their
    features, which are all 0. Without a model all scores are 0.5. Each row stands for itself:
    repeated rows get the same, equal texts tie, no rows give none, and other columns, ids and
    labels among them, are not looked at.
    """

    def compute(texts: Sequence[bytes]) -> Iterable[tuple]:
        if model is None:
            return [(0.5,)] * len(texts)
        x = np.array([features(t) for t in texts], float).reshape(-1, FEATURES)
        return [(s,) for s in model.score(x).tolist()]

    return per_text(compute, "score double")(docs[text])["score"]


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = CUT, text: str = "text") -> DataFrame:
    """``docs`` without the documents that score below ``cut``; columns are unchanged.

    The model is trained on the labelled rows among ``docs`` outside the held-out fold. Texts
    without words stay: they hold nothing to judge.
    """
    name = free_name(docs, "_score")
    scored = docs.withColumn(name, score(docs, train(docs, labels, text=text), text))
    no_words = F.coalesce(~F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(True))
    return scored.filter((F.col(name) >= cut) | no_words).drop(name)
