"""SimHash near-duplicates: popcount embedding, grid join under Manhattan distance, exact check."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import free_name, hex64, per_text
from larder.llm.components import components
from larder.sources.tables import materialize

SEED = 42
SEGMENTS = 32  # of two bits each
BLOCK = 255 * 256  # shingles turned into bits at a time
MOST_IN_RUN = 4096  # members of a cell compared in one go; larger cells are dealt out in blocks


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """The 64-bit SimHash of a text's word shingles, as a signed number; 0 for no words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    shingles = max(1, len(words) - shingle + 1)
    if shingles == 1:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        digest = xxhash.xxh64_intdigest
        hashes = [
            digest(joined[a:b], SEED)
            for a, b in zip(starts[:shingles].tolist(), ends[shingle - 1 :].tolist())
        ]
    ones = np.zeros(64, np.int64)
    for at in range(0, shingles, BLOCK):
        bits = np.unpackbits(np.array(hashes[at : at + BLOCK], ">u8").view(np.uint8))
        bits = bits.reshape(-1, 64)
        for low in range(0, len(bits), 255):  # 255 ones still fit a byte
            ones += bits[low : low + 255].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(ones * 2 > shingles).view(">i8")[0])


def embedding(fp: Column) -> Column:
    """Counts of ones in 32 segments of two bits, each written as 00, 01 or 11.

    In this form the Manhattan distance of two embeddings is the number of bits in which they
    differ. It never exceeds the Hamming distance of the fingerprints.
    """
    low = 0x5555555555555555
    next_bit = F.shiftrightunsigned(fp, 1)
    either = fp.bitwiseOR(next_bit).bitwiseAND(F.lit(low))
    both = fp.bitwiseAND(next_bit).bitwiseAND(F.lit(low))
    return either.bitwiseOR(F.shiftleft(both, 1))


def cell_masks(distance: int, groups: int) -> list[int]:
    """The coordinates that name a grid cell: all choices of ``groups - distance`` groups.

    Embeddings at Manhattan distance d differ in at most d groups of segments, so two that are
    near share the cell of at least one choice.
    """
    if not 0 <= distance < groups <= SEGMENTS:
        raise ValueError("the distance has to be less than the groups, and these at most 32")
    of = [0] * groups
    for segment in range(SEGMENTS):
        of[segment % groups] |= 3 << (2 * segment)
    masks = [sum(chosen) for chosen in combinations(of, groups - distance)]
    return [mask - (1 << 64) if mask >> 63 else mask for mask in masks]


def _forest(fps: np.ndarray, points: np.ndarray, distance: int) -> Iterator[tuple]:
    """Edges that connect whatever is linked within one cell, one fewer than its members."""
    left = np.arange(len(fps))
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            at = frontier.pop()
            near = np.bitwise_count(points[left] ^ points[at]) <= distance
            near[near] = np.bitwise_count(fps[left[near]] ^ fps[at]) <= distance
            found = left[near]
            if len(found):
                yield np.full(len(found), fps[at]), fps[found]
                frontier.extend(found.tolist())
                left = left[~near]


def _links_of_runs(keys, fps, points, distance: int, most: int):
    """Edges within runs of equal keys, and the members of runs longer than ``most``."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    lengths = np.diff(np.r_[starts, len(keys)])
    found = []
    short = np.repeat((lengths > 1) & (lengths <= 16), lengths)
    at = np.flatnonzero(short)
    lag = 1
    while len(at):  # all pairs of the short runs at once, by their distance in the run
        at = at[at + lag < len(keys)]
        at = at[keys[at] == keys[at + lag]]
        near = at[np.bitwise_count(points[at] ^ points[at + lag]) <= distance]
        near = near[np.bitwise_count(fps[near] ^ fps[near + lag]) <= distance]
        if len(near):
            found.append((fps[near], fps[near + lag]))
        lag += 1
    for run in np.flatnonzero((lengths > 16) & (lengths <= most)):
        part = slice(starts[run], starts[run] + lengths[run])
        found.extend(_forest(fps[part], points[part], distance))
    over = np.repeat(lengths > most, lengths)
    return found, keys[over], fps[over]


def _link_task(distance: int, most: int):
    """For rows sorted by cell: edges (a, b), and members (a, cell) of cells beyond ``most``."""

    def emit(found, over_keys, over_fps):
        a = [x for x, _ in found] + [over_fps]
        b = [y for _, y in found] + [np.zeros(len(over_fps), np.uint64)]
        a, b = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
        missing = np.arange(len(a)) < len(a) - len(over_fps)
        cell = pa.array(np.r_[np.zeros(missing.sum(), np.int64), over_keys], mask=missing)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), cell], ["a", "b", "cell"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []  # the run that may go on in the next batch

        def flush(parts):
            keys, fps, points = (np.concatenate(p) for p in zip(*parts))
            return _links_of_runs(keys, fps, points, distance, most)

        for batch in batches:
            keys = batch.column(0).to_numpy()
            if not len(keys):
                continue
            fps = batch.column(1).to_numpy().view(np.uint64)
            points = batch.column(2).to_numpy().view(np.uint64)
            last = int(np.searchsorted(keys, keys[-1]))
            if kept and (last or keys[0] != kept[-1][0][0]):
                yield emit(*flush([*kept, (keys[:last], fps[:last], points[:last])]))
                kept = []
            elif last:
                yield emit(*flush([(keys[:last], fps[:last], points[:last])]))
            kept.append((keys[last:], fps[last:], points[last:]))
        if kept:
            yield emit(*flush(kept))

    return run


def _linked(cells: DataFrame, distance: int, most: int) -> DataFrame:
    """Edges found in cells; ``cells`` has the columns cell, fp and point."""
    sorted_cells = cells.repartition("cell").sortWithinPartitions("cell")
    return sorted_cells.mapInArrow(_link_task(distance, most), "a long, b long, cell long")


def links(fps: DataFrame, distance: int = 4, groups: int = 7) -> DataFrame:
    """Edges ``a``, ``b`` that connect all fingerprints at ``distance`` or fewer differing bits.

    ``fps`` has distinct fingerprints in ``fp``. The result has a spanning forest of each cell's
    links, not all pairs, so that its size grows with the members. Cells with more than
    ``MOST_IN_RUN`` members are dealt out again: their members are put into blocks, and each
    pair of blocks is compared by a task of its own, so no member goes unseen. More ``groups``
    make cells finer and more of them: 7 suits up to about a hundred million fingerprints,
    8 or 9 more.
    """
    masks = cell_masks(distance, groups)
    point = embedding(F.col("fp")).alias("point")
    cells = fps.select("fp", point).select(
        F.explode(
            F.array(
                *[
                    F.xxhash64(F.lit(i), F.col("point").bitwiseAND(F.lit(mask)))
                    for i, mask in enumerate(masks)
                ]
            )
        ).alias("cell"),
        "fp",
        "point",
    )
    first = materialize(_linked(cells, distance, MOST_IN_RUN), "links")
    large = first.filter("cell is not null").select("cell", F.col("a").alias("fp"))
    half = MOST_IN_RUN // 2
    blocks = large.groupBy("cell").agg(F.ceil(F.count("*") / (half * 0.75)).alias("blocks"))
    # A block of hashed members exceeds its share by far less than the quarter left free.
    dealt = (
        large.join(blocks, "cell")
        .withColumn("block", F.pmod(F.xxhash64("fp", F.lit(7)), "blocks"))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select(
            F.xxhash64("cell", F.least("block", "other"), F.greatest("block", "other")).alias("cell"),
            "fp",
            embedding(F.col("fp")).alias("point"),
        )
    )
    second = _linked(dealt, distance, 1 << 62)
    return first.filter("cell is null").select("a", "b").unionAll(second.select("a", "b")).distinct()


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 4) -> Column:
    """A column with the SimHash of ``text``."""

    def compute(texts: list[bytes]) -> Iterable[tuple]:
        return ((fingerprint(t, shingle),) for t in texts)

    return per_text(compute, "fp long")(docs[text])["fp"]


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = 4, groups: int = 7
) -> DataFrame:
    """One row per document: its id, its fingerprint and the smallest id it is linked to.

    Texts whose fingerprints differ in ``distance`` or fewer bits are linked, and links chain.
    Whole texts count. Null texts and texts without words have fingerprint zero. Equal
    fingerprints are one node, so copies cost no comparisons; repeated rows come back repeated.
    A null id never names a component unless all ids in it are null. No rows give no rows; other
    columns are ignored whatever their names.
    """
    prints = docs.select(F.col(doc_id).alias("doc_id"), fingerprints(docs, text).alias("fp"))
    prints = materialize(prints, "fingerprints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    found = components(links(nodes.select("fp"), distance, groups))
    # The few nodes with links get the least id of their component; the others have their own.
    rooted = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    rooted = materialize(rooted, "roots")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(labels, "fp").select(
        "doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates: the one with the smallest id.

    Where several rows have that id, one of them stays, whichever its text, and where a group
    has no ids at all, one of its rows. Columns are unchanged.
    """
    row, fp = free_name(docs, "_row"), free_name(docs, "_fp")
    kept = materialize(
        docs.withColumn(row, F.monotonically_increasing_id()).withColumn(
            fp, fingerprints(docs, text)
        ),
        "documents",
    )
    order = F.struct(F.col(doc_id).isNull(), F.col(doc_id), F.col(row))
    nodes = materialize(kept.groupBy(F.col(fp).alias("fp")).agg(F.min(order).alias("best")), "nodes")
    found = components(links(nodes.select("fp"), **how)).withColumnRenamed("node", "fp")
    best = (
        nodes.join(found, "fp", "left")
        .groupBy(F.coalesce("root", "fp"))
        .agg(F.min("best").alias("best"))
        .select(F.col("best")[row].alias(row))
    )
    return kept.join(best, row, "left_semi").select(*docs.columns)
