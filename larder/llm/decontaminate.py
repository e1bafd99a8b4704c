"""Benchmark decontamination: a broadcast hash set of item windows, scanned for in token windows."""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import free_name, per_text

WINDOW = 10
MOST_WORDS = 2_000_000  # words of the items held by one broadcast set
# Lower-cases A-Z and turns whatever is no part of a word into spaces, byte by byte. Fixed by the
# contract: words are 0-9, a-z and everything outside ASCII.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32
    for c in range(256)
)
ODD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def rolling(ids: np.ndarray, length: int) -> np.ndarray:
    """A hash of each window of ``length`` consecutive numbers."""
    count = len(ids) - length + 1
    total = np.zeros(max(count, 0), np.uint64)
    if count > 0:
        for k in range(length):
            total = (total ^ ids[k : k + count]) * ODD
            total ^= total >> np.uint64(29)
    return total


def index(items: Iterable[tuple[str, bytes]], window: int = WINDOW) -> tuple[dict, dict, dict]:
    """Numbers of the items' words; per length, windows by hash; per length, the sorted hashes.

    Built-in types and arrays only, so that it can be broadcast anywhere.
    """
    number: dict[bytes, int] = {}
    found: dict[int, dict[int, list]] = {}
    for item_id, text in items:
        words = words_of(text)
        ids = np.array([number.setdefault(w, len(number) + 1) for w in words], np.uint64)
        length = min(window, len(words))
        if length:
            table = found.setdefault(length, {})
            for at, key in enumerate(rolling(ids, length).tolist()):
                table.setdefault(key, []).append((item_id, tuple(words[at : at + length])))
    hashes = {length: np.array(sorted(table), np.uint64) for length, table in found.items()}
    return number, found, hashes


def scan(windows: tuple[dict, dict, dict], text: bytes) -> tuple[int, np.ndarray, set[str]]:
    """The number of words, which of them are hit, and the items that have windows there."""
    number, found, all_hashes = windows
    words = words_of(text)
    hit = np.zeros(len(words) + 1, np.int64)
    items: set[str] = set()
    get = number.get
    ids = np.array([get(w, 0) for w in words], np.uint64)
    unknown = np.r_[0, np.cumsum(ids == 0)]
    for length, hashes in all_hashes.items():
        # Windows with a word that no item has can't be hits.
        at = np.flatnonzero(unknown[length:] == unknown[:-length])
        if not len(at):
            continue
        keys = rolling(ids, length)[at]
        place = np.minimum(np.searchsorted(hashes, keys), len(hashes) - 1)
        for i in np.flatnonzero(hashes[place] == keys).tolist():
            start = int(at[i])
            window = tuple(words[start : start + length])
            same = [item for item, w in found[length][int(keys[i])] if w == window]
            if same:  # verified, word by word
                items.update(same)
                hit[start] += 1
                hit[start + length] -= 1
    return len(words), np.cumsum(hit[:-1]) > 0, items


def runs(hit: np.ndarray) -> list[tuple[int, int]]:
    """The first and last index of each run of hits."""
    edges = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
    return [(int(a), int(b) - 1) for a, b in zip(edges[::2], edges[1::2])]


def _blocks(items: DataFrame, item_id: str, text: str, most_words: int) -> list[list[tuple]]:
    """The items, in as many blocks as keep each within ``most_words``, read block by block.

    A text's bytes bound its words. A benchmark is a stated set of texts, not a corpus; that the
    driver can hold it is checked here.
    """
    size = F.octet_length(F.col(text))
    total = items.agg(F.sum(size).alias("b")).first()["b"] or 0
    if total > 100 * most_words:
        raise ValueError(f"{total} bytes of items: split the benchmark and run its parts in turn")
    rows = items.filter(F.col(text).isNotNull()).select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("null")), F.col(text)
    )
    blocks: list[list[tuple]] = [[]]
    held = 0
    for name, value in rows.toLocalIterator():
        if held > most_words:
            blocks.append([])
            held = 0
        blocks[-1].append((name, value.encode()))
        held += len(words_of(value.encode()))
    return blocks


def hits(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    most_words: int = MOST_WORDS,
) -> Column:
    """A column of ``docs`` with what a scan for the items' windows finds in each text.

    A struct: ``n_words``; ``n_hit``, the words within an occurrence of a window; ``items``, the
    ids of items with windows there, sorted as strings; ``spans``, the first and last word of
    each run that is hit. The windows of about ``most_words`` words of items are broadcast at
    most; a larger benchmark is scanned for in blocks and the findings are joined per text.

    Words are runs of 0-9, A-Z in either case and anything outside ASCII. An item of fewer than
    ``window`` words, but not none, is one window. Nulls and empty texts have no words and hit
    nothing; an item with a null id counts under the id ``null``; items with one id are one. Each
    document stands for itself: repeated rows get the same, no rows give none, an empty benchmark
    hits nothing, and other columns are not looked at.
    """
    context = docs.sparkSession.sparkContext
    schema = "n_words long, items array<string>, spans array<struct<a: int, b: int>>"
    parts = []
    for block in _blocks(items, item_id, item_text, most_words):
        shared = context.broadcast(index(block, window))

        def compute(texts: list[bytes], shared=shared) -> Iterable[tuple]:
            for t in texts:
                n, hit, found = scan(shared.value, t)
                yield n, sorted(found), [{"a": a, "b": b} for a, b in runs(hit)]

        parts.append(per_text(compute, schema)(docs[text]))
    spans = F.flatten(F.array(*[part["spans"] for part in parts]))
    named = F.flatten(F.array(*[part["items"] for part in parts]))
    words = F.flatten(F.transform(spans, lambda s: F.sequence(s["a"], s["b"])))
    return F.struct(
        parts[0]["n_words"].alias("n_words"),
        F.size(F.array_distinct(words)).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(named)).alias("items"),
        spans.alias("spans"),
    )


def clean_documents(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """``docs`` without the documents that hold a window of an item; columns are unchanged."""
    found = free_name(docs, "_hits")
    how.setdefault("text", "text")
    return docs.withColumn(found, hits(docs, items, **how)).filter(
        F.col(found)["n_hit"] == 0
    ).drop(found)


WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")  # of texts in either case


def cut(text: str, spans: list) -> str:
    """A text without the words of inclusive spans, and what stands between them."""
    at = [m.span() for m in WORD.finditer(text)]
    kept, start = [], 0
    for a, b in sorted((s["a"], s["b"]) for s in spans):
        kept.append(text[start : max(start, at[a][0])])
        start = max(start, at[b][1])
    return "".join(kept) + text[start:]


def _cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
    return pa.array(map(cut, texts.to_pylist(), spans.to_pylist()), pa.string())


_cut.__annotations__ = {k: pa.Array for k in ("texts", "spans", "return")}


def clean_spans(docs: DataFrame, items: DataFrame, text: str = "text", **how) -> DataFrame:
    """``docs`` with the hit words cut out of ``text``; the other columns are unchanged."""
    found = free_name(docs, "_hits")
    cleaned = F.arrow_udf(_cut, "string")(F.coalesce(F.col(text), F.lit("")), F.col(found)["spans"])
    hit = docs.withColumn(found, hits(docs, items, text=text, **how))
    return hit.withColumn(
        text, F.when(F.col(found)["n_hit"] > 0, cleaned).otherwise(F.col(text))
    ).drop(found)
