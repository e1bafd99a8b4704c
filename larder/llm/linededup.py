"""Repeated runs of lines: winnowed line hashes, joined positions, matches extended both ways."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import free_name, per_text
from larder.sources.tables import materialize

WINDOW = "window long, low int, high int"


def solid_lines(text: bytes) -> tuple[list[int], list[bytes]]:
    """The lines with words, without spaces at their ends, and their numbers."""
    lines = [line.strip() for line in text.split(b"\n")]
    at = [i for i, line in enumerate(lines) if line]
    return at, [lines[i] for i in at]


def windows(words: np.ndarray, min_words: int) -> list[tuple[int, int]]:
    """The windows of a text by the words of its lines: first line, and one past the last.

    A window holds ``min_words`` words, and would not without its last line or without its first.
    Whether lines are a window depends on nothing else, so a run of that many words that stands in
    two places has the same windows in both; and they cover it, since of any of its lines either the
    window that starts there, or the one that ends there, or one between lies within the run.
    """
    before = np.r_[0, np.cumsum(words)]
    lines = np.arange(len(words))
    ends = np.searchsorted(before, before[:-1] + min_words)
    starts = np.searchsorted(before, before[1:] - min_words, side="right") - 1
    whole = ends <= len(words)
    found = set(zip(lines[whole].tolist(), ends[whole].tolist()))
    fits = before[1:] >= min_words
    found |= set(zip(starts[fits].tolist(), (lines[fits] + 1).tolist()))
    return sorted(found)


def minima(hashes: list[int], spans: list[tuple[int, int]]) -> list[int]:
    """Winnowing: the places of the least line hash of each window, the last of equal ones.

    Windows that overlap mostly share theirs, so few lines are selected, and a window has its
    least hash wherever it stands: two places with the same run select the same of its lines.
    """
    chosen: list[int] = []
    for low, high in spans:
        if chosen and low <= chosen[-1] < high and high - 1 == last:
            continue  # only lines above the least one have left
        least = min(hashes[low:high])
        place = high - 1 - hashes[low:high][::-1].index(least)
        last = high - 1
        if not chosen or place != chosen[-1]:
            chosen.append(place)
    return sorted(set(chosen))


def line_table(docs: DataFrame, row: str, doc_id: str, text: str, min_words: int) -> DataFrame:
    """What is compared of each document, without its text: its place, lines and selected lines.

    ``place`` orders documents: by the smaller id, nulls last, then by ``row``, a unique column.
    """

    def compute(texts: list[bytes]) -> Iterable[tuple]:
        for text in texts:
            at, lines = solid_lines(text)
            counts = [len(line.split()) for line in lines]
            hashes = [xxhash.xxh64_intdigest(line) - (1 << 63) for line in lines]
            spans = windows(np.array(counts, np.int64), min_words)
            chosen = [hashes[i] for i in minima(hashes, spans)]
            yield text.count(b"\n") + 1, at, counts, hashes, chosen

    schema = "n_lines int, at array<int>, words array<int>, hashes array<long>, chosen array<long>"
    found = docs.select(
        F.col(row).alias("row"),
        F.struct(
            F.col(doc_id).isNull().alias("no_id"),
            F.col(doc_id).alias("doc_id"),
            F.col(row).alias("row"),
        ).alias("place"),
        per_text(compute, schema)(docs[text]).alias("lines"),
    )
    return materialize(found.select("row", "place", "lines.*"), "lines")


def _extended(min_words: int):
    """For lines and fingerprints found elsewhere: the windows around these, by all their lines."""

    def run(hashes: pa.Array, words: pa.Array, live: pa.Array) -> pa.Array:
        rows = []
        for line_hashes, counts, marks in zip(*(x.to_pylist() for x in (hashes, words, live))):
            marks, packed, found = set(marks), np.array(line_hashes, np.int64), []
            for low, high in windows(np.array(counts, np.int64), min_words):
                if min(line_hashes[low:high]) in marks:
                    whole = xxhash.xxh64_intdigest(packed[low:high].tobytes()) - (1 << 63)
                    found.append({"window": whole, "low": low, "high": high - 1})
            rows.append(found)
        kind = pa.struct([("window", pa.int64()), ("low", pa.int32()), ("high", pa.int32())])
        return pa.array(rows, pa.list_(kind))

    run.__annotations__ = {k: pa.Array for k in ("hashes", "words", "live", "return")}
    return F.arrow_udf(run, f"array<struct<{WINDOW}>>")


def repeats(lines: DataFrame, min_words: int) -> DataFrame:
    """Windows that occur before, as ``row``, ``low`` and ``high``, lines counted among those with
    words.

    Positions are joined on their fingerprints: a selected line whose hash is selected nowhere else
    is in no repeated window, and most texts end there. From the others the match is extended up
    and down to every window around the line, and these are told apart by the hashes of all their
    lines. A window that is not the first of its content, by ``place`` and position, occurs before,
    whichever of the earlier places it is that a longer run has in common with this one. So no
    pairs are made: a window is a row, its group's first a partial aggregate, and the joins are
    split by adaptive execution.
    """
    marks = lines.select("row", F.explode("chosen").alias("mark"))
    twice = marks.groupBy("mark").agg(F.count("*").alias("n")).filter("n > 1").select("mark")
    live = (
        lines.select("row", F.explode(F.array_distinct("chosen")).alias("mark"))
        .join(twice, "mark")
        .groupBy("row")
        .agg(F.collect_list("mark").alias("live"))
    )
    found = lines.select("row", "place", "hashes", "words").join(live, "row")
    around = found.select(
        "row", "place", F.explode(_extended(min_words)("hashes", "words", "live")).alias("w")
    )
    placed = materialize(around.select("row", "place", "w.*"), "windows")
    first = (
        placed.groupBy("window")
        .agg(F.count("*").alias("n"), F.min(F.struct("place", "low")).alias("first"))
        .filter("n > 1")
        .select("window", F.col("first.place.row").alias("first_row"), F.col("first.low").alias("first_low"))
    )
    later = placed.join(first, "window").filter("row <> first_row OR low <> first_low")
    return later.select("row", "low", "high")


def merge(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Inclusive spans, sorted, with those that touch or overlap joined."""
    merged: list[tuple[int, int]] = []
    for low, high in sorted(spans):
        if merged and low <= merged[-1][1] + 1:
            merged[-1] = (merged[-1][0], max(merged[-1][1], high))
        else:
            merged.append((low, high))
    return merged


def _removed(lows: pa.Array, highs: pa.Array, at: pa.Array, words: pa.Array) -> pa.Array:
    rows = []
    for low, high, lines, counts in zip(*(x.to_pylist() for x in (lows, highs, at, words))):
        merged = merge(zip(low or [], high or []))
        gone = [f"{lines[a]}-{lines[b]}" for a, b in merged]
        rows.append((",".join(gone), sum(sum(counts[a : b + 1]) for a, b in merged)))
    spans, cut_words = zip(*rows) if rows else ((), ())
    arrays = [pa.array(spans, pa.string()), pa.array(cut_words, pa.int64())]
    return pa.StructArray.from_arrays(arrays, names=["lines_removed", "words_removed"])


_removed.__annotations__ = {k: pa.Array for k in ("lows", "highs", "at", "words", "return")}


def removals(
    docs: DataFrame, row: str, doc_id: str = "doc_id", text: str = "text", min_words: int = 50
) -> DataFrame:
    """What to cut from each document: ``row``, ``doc_id``, ``n_lines``, and what `dedup` adds."""
    lines = line_table(docs, row, doc_id, text, min_words)
    spans = repeats(lines, min_words).groupBy("row").agg(F.collect_set(F.struct("low", "high")).alias("s"))
    removed = F.arrow_udf(_removed, "lines_removed string, words_removed long")
    return (
        lines.select("row", "place", "n_lines", "at", "words")
        .join(spans, "row", "left")
        .select(
            F.col("row").alias(row),
            F.col("place.doc_id").alias("doc_id"),
            F.col("n_lines").cast("long").alias("n_lines"),
            removed(F.col("s.low"), F.col("s.high"), "at", "words").alias("removed"),
        )
        .select(row, "doc_id", "n_lines", "removed.*")
    )


def cut(text: str, spans: str) -> str:
    """A text without the lines that ``spans`` names, such as ``3-7,12-12``."""
    lines, kept, start = text.split("\n"), [], 0
    for span in spans.split(","):
        low, high = map(int, span.split("-"))
        kept.extend(lines[start:low])
        start = high + 1
    return "\n".join(kept + lines[start:])


def _cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
    return pa.array(map(cut, texts.to_pylist(), spans.to_pylist()), pa.string())


_cut.__annotations__ = {k: pa.Array for k in ("texts", "spans", "return")}


def dedup(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = 50
) -> DataFrame:
    """``docs`` with later repeats of runs of ``min_words`` or more words cut out of ``text``.

    A run is cut whole wherever any earlier place has it, whatever the other places have.

    Adds ``lines_removed`` (string, such as ``3-7,12-12``; numbers of lines from 0) and
    ``words_removed`` (long). Two lines are equal if they are but for spaces at their ends.
    Whole texts are compared. A run is looked for in all other documents and in its own. Runs
    within one line, or shorter ones, stay; empty lines between lines that are cut go too. Of a run that
    overlaps its own repeat the first period stays. Every line that is cut occurs in an earlier
    place that keeps it. Rows with the same id are taken in the order in which they are read. Null texts stay null, empty ones empty; a text of repeats alone becomes
    empty. Repeated rows are copies like any others; rows with a null id come last. No rows give
    no rows. Other columns pass through; two with the names of the added ones are replaced.
    """
    row = free_name(docs, "_row")
    docs = docs.drop("lines_removed", "words_removed")
    docs = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "documents")
    changes = removals(docs, row, doc_id, text, min_words).select(
        row, "lines_removed", "words_removed"
    )
    changed = changes.filter("lines_removed <> ''")
    return (
        docs.join(changed, row, "left")
        .drop(row)
        .withColumns(
            {
                text: F.when(
                    F.col("lines_removed").isNotNull(),
                    F.arrow_udf(_cut, "string")(
                        F.when(F.col("lines_removed").isNotNull(), F.col(text)).otherwise(""),
                        F.coalesce("lines_removed", F.lit("0-0")),
                    ),
                ).otherwise(F.col(text)),
                "lines_removed": F.coalesce("lines_removed", F.lit("")),
                "words_removed": F.coalesce("words_removed", F.lit(0)).cast("long"),
            }
        )
    )
