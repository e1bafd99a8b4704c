"""MinHash near-duplicates: SuperMinHash signatures, bands, exact verification, union-find groups."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import per_text
from larder.llm.components import components
from larder.sources.tables import materialize

SEED = 97
WORDS = 3  # of a shingle
THRESHOLD = 85  # hundredths of the union that two sets have to share
BANDS, ROWS = 32, 5  # at the threshold a pair shares no band with probability (1 - .85**5)**32, 7e-9
LENGTH = BANDS * ROWS
SLACK = 0.17  # six deviations of the similarity that two signatures tell, at the threshold
MOST_IN_BUCKET = 4096  # members of a bucket compared in one go; larger ones are dealt out in blocks
MOST_SHINGLES = 4 << 20  # of the sets verified in one go, 32 MB; larger clusters are dealt out too
PIECE = 1 << 13  # elements of a set worked on at a time


class Sketch(NamedTuple):
    n_shingles: int
    key: bytes  # of the whole set
    signature: bytes


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """The hashes of a text's distinct word shingles, ascending; fewer words are one shingle."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([digest(b" ".join(found), SEED)], np.uint64)
    joined = b" ".join(found)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    return np.unique(np.array(
        [digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist())], np.uint64
    ))


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """Independent uniform 64-bit numbers from elements, one for each salt (SplitMix's finalizer)."""
    x = x + np.uint64((salt + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def superminhash(elements: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The SuperMinHash of a set of hashes: ``length`` values, each a rank and a fraction.

    Every element deals its ranks 0, 1, 2 .. out to the positions in a random order of its own,
    each with a random fraction, and a position keeps the least value it gets. So an element has
    one value in every position, and values of one element are correlated: no two share a rank.
    All elements deal out rank 0, then rank 1 and so on, and the work stops early, once no
    position holds a value above the rank to come: for sets much larger than the signature after
    the first. The order of the elements makes no difference.
    """
    best = np.full(length, np.inf)
    if not len(elements):
        return best
    pieces = [elements[i : i + PIECE] for i in range(0, len(elements), PIECE)]
    orders: list = [None] * len(pieces)  # what is left of each element's permutation
    for rank in range(length):
        if best.max() < rank:
            break
        for i, piece in enumerate(pieces):
            drawn = _mixed(piece, rank)
            fraction = (drawn >> np.uint64(11)) * 2.0**-53
            # The swap of this step of Fisher and Yates, from bits of another draw.
            other = _mixed(drawn, rank + length) >> np.uint64(32)
            swap = rank + (other % np.uint64(length - rank)).astype(np.int64)
            if rank == 0 and len(elements) > 12 * length:
                # So many elements leave a position empty once in 160,000 sets; then the next rank
                # makes up what this one has not kept.
                position = swap
            else:
                if orders[i] is None:
                    orders[i] = _orders(piece, rank, length)
                rows, order = np.arange(len(piece)), orders[i]
                position = order[rows, swap]
                order[rows, swap] = order[:, rank]
            np.minimum.at(best, position, rank + fraction)
    return best


def _orders(piece: np.ndarray, done: int, length: int) -> np.ndarray:
    """The permutations of elements after ``done`` steps."""
    order = np.tile(np.arange(length, dtype=np.int16), (len(piece), 1))
    rows = np.arange(len(piece))
    for rank in range(done):
        other = _mixed(_mixed(piece, rank), rank + length) >> np.uint64(32)
        swap = rank + (other % np.uint64(length - rank)).astype(np.int64)
        order[rows, swap] = order[:, rank]
    return order


def sketch(text: bytes, words: int = WORDS) -> Sketch:
    """Size, key and signature of a text's set; a signature has 16 bits of a hash of each value."""
    found = shingles(text, words)
    if not len(found):
        return Sketch(0, b"", b"")
    key = xxhash.xxh3_128_digest(found.astype("<u8").tobytes(), SEED)
    values = superminhash(found)
    return Sketch(len(found), key, _mixed(values.view(np.uint64), SEED).astype("<u2").tobytes())


def band_keys(signature: Column) -> Column:
    """The hashes of a signature's bands."""
    size = 2 * ROWS
    return F.array(
        *[
            F.xxhash64(F.lit(band), F.substring(signature, 1 + band * size, size))
            for band in range(BANDS)
        ]
    )


def alike(signature: np.ndarray, others: np.ndarray, least: float) -> np.ndarray:
    """Which of ``others`` agree with a signature in a share of ``least`` or more."""
    return (others == signature).sum(axis=1) >= least * len(signature)


def _forest(signatures: np.ndarray, least: float) -> Iterator[tuple[int, np.ndarray]]:
    """Edges that connect whatever looks alike, one fewer than the members of each part."""
    left = np.arange(len(signatures))
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            at = frontier.pop()
            near = alike(signatures[at], signatures[left], least)
            if near.any():
                yield at, left[near]
                frontier.extend(left[near].tolist())
                left = left[~near]


def linked(a: np.ndarray, b: np.ndarray, threshold: int) -> bool:
    """Whether two sets share ``threshold`` hundredths of their union or more."""
    less, more = sorted((len(a), len(b)))
    if 100 * less < threshold * more:
        return False
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    common = int((large[at] == small).sum())
    return 100 * common >= threshold * (len(a) + len(b) - common)


class Union:
    """Union-find over the members of a group; the root is the first member."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return self.parent
            self.parent = up

    def join(self, a: int, b: int) -> None:
        roots = self.roots()
        low, high = sorted((int(roots[a]), int(roots[b])))
        self.parent[roots == high] = low


def _verified(sets: list[np.ndarray], signatures: np.ndarray, threshold: int):
    """Edges that connect whatever is linked in a group, by its full sets.

    Members that already are in one part are not compared again, so copies that vary a little
    cost one comparison each.
    """
    union = Union(len(sets))
    least = threshold / 100 - SLACK
    for at in range(len(sets) - 1):
        roots = union.roots()
        behind = np.flatnonzero(roots[at + 1 :] != roots[at]) + at + 1
        if not len(behind):
            continue
        for other in behind[alike(signatures[at], signatures[behind], least)].tolist():
            if union.parent[other] != union.parent[at] and linked(sets[at], sets[other], threshold):
                union.join(at, other)
                yield at, other


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The runs of equal values in the first column of sorted batches."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        ends = pc.run_end_encode(batch.column(0), run_end_type=pa.int32())
        start = 0
        for value, stop in zip(ends.values, ends.run_ends.to_pylist()):
            if kept and kept[-1].column(0)[-1] != value:
                yield pa.Table.from_batches(kept)
                kept = []
            kept.append(batch.slice(start, stop - start))
            start = stop
    if kept:
        yield pa.Table.from_batches(kept)


def _signatures(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(len(column), LENGTH)


def _edges(a: list[bytes], b: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])


def _bucket_task(least: float):
    """For members sorted by bucket: edges between those whose signatures are alike."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for members in _runs(batches):
            if len(members) > 1:
                keys = members.column("key").to_pylist()
                for one, others in _forest(_signatures(members.column("signature")), least):
                    a += [keys[one]] * len(others)
                    b += [keys[i] for i in others.tolist()]
            if len(a) > 10_000:
                yield _edges(a, b)
                a, b = [], []
        yield _edges(a, b)

    return run


def _verify_task(threshold: int):
    """For members sorted by group: edges between those whose sets are linked."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for members in _runs(batches):
            keys = members.column("key").to_pylist()
            sets = [np.frombuffer(s, "<u8") for s in members.column("elements").to_pylist()]
            found = _verified(sets, _signatures(members.column("signature")), threshold)
            for one, other in found:
                a.append(keys[one])
                b.append(keys[other])
            if len(a) > 10_000:
                yield _edges(a, b)
                a, b = [], []
        yield _edges(a, b)

    return run


def _dealt(members: DataFrame, group: str, blocks: DataFrame) -> DataFrame:
    """Members of large groups, once for each block that theirs is compared with.

    ``blocks`` has the number of blocks of every group with more than one. Members fall into blocks
    by a hash, before any shuffle by group, and each pair of blocks is a group of its own.
    """
    number = F.coalesce("blocks", F.lit(1))
    block = F.pmod(F.xxhash64("key", F.lit(SEED)), number)
    other = F.explode(F.sequence(F.lit(0).cast("long"), number - 1))
    return (
        members.join(blocks, group, "left")
        .withColumn("block", block)
        .withColumn("other", other)
        .withColumn(
            "group",
            F.xxhash64(group, F.least("block", "other"), F.greatest("block", "other")),
        )
        .drop("blocks", "block", "other", *([group] if group != "group" else []))
    )


def _sketches(texts: Column, words: int) -> Column:
    def compute(batch: list[bytes]) -> Iterable[tuple]:
        return (sketch(text, words) for text in batch)

    return per_text(compute, "n_shingles long, key binary, signature binary")(texts)


def _elements(texts: Column, words: int) -> Column:
    def compute(batch: list[bytes]) -> Iterable[tuple]:
        return ((shingles(text, words).astype("<u8").tobytes(),) for text in batch)

    return per_text(compute, "elements binary")(texts)["elements"]


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    threshold: int = THRESHOLD,
    words: int = WORDS,
    most_in_bucket: int = MOST_IN_BUCKET,
    most_shingles: int = MOST_SHINGLES,
) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles``, ``component_id`` and ``kept``.

    Two documents are linked if their sets of word shingles share ``threshold`` hundredths of
    their union, and links chain; ``component_id`` is the smallest id that can be reached, and
    the document that has it is ``kept``. Whole texts count. Texts that are null or have no
    words have no shingles and are linked with nothing. Repeated rows come back repeated. Null
    ids are smaller than none: they name a component only if all its ids are null, and are kept
    then. No rows give no rows; other columns are ignored whatever their names.

    Equal sets are one node from the start. Nodes that share a band of their signatures and look
    alike to within six deviations are joined to clusters, by a spanning forest of every bucket.
    Each node's full set is then sent to its cluster once, and only what the sets confirm links
    documents. Buckets and clusters beyond a bound are dealt out in pairs of blocks by their
    counts, before they are shuffled, so no member goes unseen. Thresholds far below 85 need more
    bands than the module has.
    """
    source = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")
    ).withColumn("same", F.xxhash64("text"))
    found = source.select("doc_id", "same", _sketches(F.col("text"), words).alias("s"))
    found = materialize(found.select("doc_id", "same", "s.*"), "sketches")
    nodes = (
        found.filter("n_shingles > 0")
        .groupBy("key")
        .agg(
            F.min("doc_id").alias("least"),
            F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "same")).alias("text_of"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("signature").alias("signature"),
        )
    )
    nodes = materialize(nodes, "nodes")
    banded = nodes.select("key", F.explode(band_keys(F.col("signature"))).alias("bucket"))
    # Buckets of the same members are one, which two sums of hashes tell.
    content = [F.bit_xor(F.xxhash64("key")), F.bit_xor(F.xxhash64("key", F.lit(SEED)))]
    counts = (
        banded.groupBy("bucket")
        .agg(F.count("*").alias("n"), content[0].alias("x"), content[1].alias("y"))
        .filter("n > 1")
        .groupBy("n", "x", "y")
        .agg(F.min("bucket").alias("bucket"))
    )
    counts = materialize(counts.select("bucket", "n"), "buckets")
    large = counts.filter(F.col("n") > most_in_bucket).select(
        "bucket", F.ceil(F.col("n") / (0.75 * most_in_bucket / 2)).alias("blocks")
    )
    shared = banded.join(counts.select("bucket"), "bucket", "left_semi")
    dealt = _dealt(shared, "bucket", large).join(nodes.select("key", "signature"), "key")
    alike_edges = (
        dealt.select("group", "key", "signature")
        .repartition("group")
        .sortWithinPartitions("group")
        .mapInArrow(_bucket_task(threshold / 100 - SLACK), "a binary, b binary")
    )
    clusters = materialize(components(alike_edges), "clusters")
    roots = clusters.select(F.col("root").alias("key")).distinct()
    member = clusters.unionAll(roots.select("key", "key")).toDF("key", "cluster")
    wanted = materialize(nodes.drop("least").join(member, "key"), "members")
    # What a task holds is bounded in shingles and in members.
    weight = F.col("n_shingles") + most_shingles // most_in_bucket
    sizes = wanted.groupBy("cluster").agg(F.sum(weight).alias("n"))
    blocks = sizes.filter(F.col("n") > most_shingles).select(
        "cluster", F.ceil(F.col("n") / (0.75 * most_shingles / 2)).alias("blocks")
    )
    one_text = F.col("doc_id").eqNullSafe(F.col("text_of.doc_id")) & (
        F.col("same") == F.col("text_of.same")
    )
    texts = source.join(wanted, one_text).dropDuplicates(["key"])
    sets = texts.select("key", "cluster", "signature", _elements(F.col("text"), words).alias("elements"))
    links = (
        _dealt(sets, "cluster", blocks)
        .select("group", "key", "signature", "elements")
        .repartition("group")
        .sortWithinPartitions("group")
        .mapInArrow(_verify_task(threshold), "a binary, b binary")
    )
    joined = components(links).withColumnRenamed("node", "key")
    rooted = nodes.select("key", "least").join(joined, "key", "left")
    rooted = materialize(rooted.withColumn("root", F.coalesce("root", "key")), "roots")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = rooted.join(least, "root").select("key", "component_id")
    alone = F.col("n_shingles") == 0
    return (
        found.select("doc_id", "n_shingles", "key")
        .join(labels, "key", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        )
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )
