"""Alignment of two tokenizers: common token ends cut groups, overlaps link tokens, counts rank links."""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from larder.llm.common import once_per_process
from larder.sources.tables import materialize

BYTE_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
# Fixed: how byte-level vocabularies part a text into words before they merge.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONGEST_RUN = 4096
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
IDS = 1 << 20  # ids of either vocabulary are below; a pair of ids is a * IDS + b
CHUNK = 4 << 20  # characters of text whose links share one list of pairs
HEAD = 8  # ends of the shorter list that gallop from one place of the longer


class Tokenizer(NamedTuple):
    encode: Callable[[list[str]], list[list[int]]]
    pieces: list[bytes]  # the bytes of each id


class Aligned(NamedTuple):
    a: np.ndarray  # ids
    b: np.ndarray
    cuts_a: np.ndarray  # how many tokens lie before the end of each group
    cuts_b: np.ndarray
    pairs: np.ndarray  # a * IDS + b of every link, in order


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies.

    Printable characters of Latin-1 stand for themselves, the other bytes in their order for the
    characters from U+0100 on.
    """
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [byte for byte in range(256) if byte not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def byte_tokenizer(path: str = BYTE_VOCABULARY) -> Tokenizer:
    """A byte-level vocabulary; strings of special tokens are plain text.

    Where ids follow the merges, as they do in vocabularies that were trained once and never
    edited, merging by the least id is the same as merging by the first rule, and an encoder that
    needs ids alone takes the texts; it is several times as fast and the tests compare the two.
    Texts with a run of over ``LONGEST_RUN`` bytes with or without white space, on which it takes
    quadratic time, are left to the library that the file is written for.
    """
    with open(path, encoding="utf-8") as file:
        stated = json.load(file)
    alphabet = byte_alphabet()
    ids = stated["model"]["vocab"] | {t["content"]: t["id"] for t in stated["added_tokens"]}
    pieces = [b""] * (max(ids.values()) + 1)
    for token, i in ids.items():
        known = all(c in alphabet for c in token)
        pieces[i] = bytes(alphabet[c] for c in token) if known else token.encode()
    by_ids = _encoder_by_ids(stated, alphabet)
    del stated, ids
    kept: list = []

    def library():
        if not kept:  # most processes never meet a text that needs it
            from tokenizers import Tokenizer as Library

            kept.append(Library.from_file(path))
            kept[0].encode_special_tokens = True
        return kept[0]

    def encode(texts: list[str]) -> list[list[int]]:
        found: list = [None] * len(texts)
        rest = [i for i, text in enumerate(texts) if by_ids is None or _longest_run(text) > LONGEST_RUN]
        if rest:
            chosen = library().encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)
            for i, e in zip(rest, chosen):
                found[i] = e.ids
        return [by_ids(text) if ids is None else ids for text, ids in zip(texts, found)]

    return Tokenizer(encode, pieces)


def _encoder_by_ids(stated: dict, alphabet: dict[str, int]) -> Callable[[str], list[int]] | None:
    """An encoder that merges by the least id, where a vocabulary's rules come to that."""
    import tiktoken

    model, splits = stated["model"], stated["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not stated["normalizer"] and not model.get("dropout")
    plain = plain and splits.get("type") == "ByteLevel" and not splits.get("add_prefix_space")
    ids = model["vocab"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    merged = [ids.get("".join(m)) for m in merges]
    single = len(ids) - len(merges)
    if not plain or not splits.get("use_regex") or merged != list(range(single, len(ids))):
        return None
    ranks = {bytes(alphabet[c] for c in token): i for token, i in ids.items()}
    return tiktoken.Encoding(
        "own", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={}
    ).encode_ordinary


def _longest_run(text: str) -> int:
    """The most bytes in a row that are all white space or all none."""
    is_space = SPACE[np.frombuffer(text.encode(), np.uint8)]
    edges = np.flatnonzero(is_space[1:] != is_space[:-1])
    return int(np.diff(edges, prepend=-1, append=len(is_space) - 1).max(initial=0))


def piece_tokenizer(path: str = PIECE_VOCABULARY) -> Tokenizer:
    """A vocabulary of pieces with bytes to fall back on; it puts a space before every text."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = []
    for i in range(library.get_piece_size()):
        piece = library.id_to_piece(i)
        pieces.append(
            bytes([int(piece[3:5], 16)])
            if library.is_byte(i)
            else piece.replace("▁", " ").encode()
        )

    def encode(texts: list[str]) -> list[list[int]]:
        return library.encode(texts, num_threads=1)

    return Tokenizer(encode, pieces)


def gallop(shorter: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """Places in ``longer`` of the first value not below each of ``shorter``; both ascend.

    Every eighth value is looked up first, in the same way; the others gallop on from the place
    of the one before them, all at once: steps double until they pass the value, then the bracket
    is halved. So each costs the logarithm of how far it lies from its neighbour.
    """
    n, m = len(shorter), len(longer)
    if not n:
        return np.zeros(0, np.int64)
    low = np.zeros(n, np.int64)
    if n > HEAD:
        low = np.repeat(gallop(shorter[::HEAD], longer), HEAD)[:n]
    high = low.copy()
    step, open_ = 1, np.arange(n)
    while len(open_):
        ahead = low[open_] + step
        at_end = ahead > m
        ahead[at_end] = m
        passed = (longer[ahead - 1] < shorter[open_]) & ~at_end
        high[open_] = ahead
        open_ = open_[passed]
        low[open_] = ahead[passed]
        step *= 2
    open_ = np.flatnonzero(low < high)
    while len(open_):
        middle = (low[open_] + high[open_]) >> 1
        below = longer[middle] < shorter[open_]
        low[open_[below]] = middle[below] + 1
        above = ~below
        high[open_[above]] = middle[above]
        open_ = open_[low[open_] < high[open_]]
    return low


def align_all(
    all_a: list[np.ndarray], all_b: list[np.ndarray], len_a: np.ndarray, len_b: np.ndarray
) -> list[Aligned]:
    """Groups and links of two tokenizations of each text; those without tokens have none.

    The shorter list of token ends is looked up in the longer. The place of an end is the rank
    at which the other list has to be cut, so equal ends are the cuts of the groups, and the
    difference of an interval's two ranks is how many tokens of the other list it overlaps. All
    texts are looked up as one, as both lists end where a text does.
    """
    a, b = np.concatenate(all_a), np.concatenate(all_b)
    none = np.zeros(0, np.int64)
    if not len(a):
        return [Aligned(none, none, none, none, none) for _ in all_a]
    ends_a, ends_b = np.cumsum(len_a[a]), np.cumsum(len_b[b])
    a_is_short = len(a) <= len(b)
    short, long_ = (ends_a, ends_b) if a_is_short else (ends_b, ends_a)
    place = gallop(short, long_)
    common = long_[place] == short
    own, other = np.flatnonzero(common) + 1, place[common] + 1
    # Token i of the shorter list overlaps those from the one that holds its first byte, which is
    # the one after the end before, if common, to the one whose end is not below its own.
    first = np.zeros(len(short), np.int64)
    first[1:] = place[:-1] + common[:-1]
    overlaps = place - first + 1
    upto = np.cumsum(overlaps)
    left = np.repeat(np.arange(len(short)), overlaps)
    right = np.arange(len(left)) - np.repeat(upto - overlaps - first, overlaps)
    if a_is_short:
        cuts_a, cuts_b, pairs = own, other, a[left] * IDS + b[right]
    else:
        cuts_a, cuts_b, pairs = other, own, a[right] * IDS + b[left]
    until_a = np.cumsum([len(x) for x in all_a])
    until_b = np.cumsum([len(x) for x in all_b])
    groups = np.searchsorted(cuts_a, until_a, "right").tolist()
    links = np.append(0, upto)[until_a if a_is_short else until_b].tolist()
    found, group, link, at_a, at_b = [], 0, 0, 0, 0
    for i, (x, y) in enumerate(zip(all_a, all_b)):
        g, k = slice(group, groups[i]), slice(link, links[i])
        found.append(Aligned(x, y, cuts_a[g] - at_a, cuts_b[g] - at_b, pairs[k]))
        group, link, at_a, at_b = groups[i], links[i], until_a[i], until_b[i]
    return found


MARKS = (",", "|", ";", "")


def spelled(ids: int) -> list[str]:
    """The decimal form of ids below ``ids`` with each of the marks that may follow."""
    return [str(i) + mark for i in range(ids) for mark in MARKS]


def written(aligned: Aligned, names: list[str]) -> str:
    """The groups as ``a1,a2|b1;a3|b2,b3``; ``names`` is what :func:`spelled` gives."""
    a, b, cuts_a, cuts_b = aligned.a, aligned.b, aligned.cuts_a, aligned.cuts_b
    if not len(cuts_a):
        return ""
    codes = np.empty(len(a) + len(b), np.int64)
    # Behind the tokens of a in a group come those of b, so each moves by the cuts of the other.
    sizes_a, sizes_b = np.diff(cuts_a, prepend=0), np.diff(cuts_b, prepend=0)
    codes[np.arange(len(a)) + np.repeat(cuts_b - sizes_b, sizes_a)] = a * len(MARKS)
    codes[np.arange(len(b)) + np.repeat(cuts_a, sizes_b)] = b * len(MARKS)
    codes[cuts_a - 1 + cuts_b - sizes_b] += MARKS.index("|")
    codes[cuts_a + cuts_b - 1] += MARKS.index(";")
    codes[-1] += MARKS.index("") - MARKS.index(";")
    return "".join([names[code] for code in codes.tolist()])


class Aligner:
    """Two tokenizers and what is derived from them once."""

    def __init__(self, a: Tokenizer, b: Tokenizer):
        self.a, self.b = a, b
        self.len_a = np.array([len(p) for p in a.pieces], np.int64)
        self.len_b = np.array([len(p) for p in b.pieces], np.int64)
        if max(len(a.pieces), len(b.pieces)) > IDS:
            raise ValueError(f"ids have to be below {IDS}")
        self.names = spelled(max(len(a.pieces), len(b.pieces)))

    def __call__(self, texts: list[str | None]) -> list[Aligned]:
        """The alignment of each text, with no tokens where either's bytes are not space + text."""
        real = [text for text in texts if text]
        ids_a = iter(self.a.encode([" " + text for text in real]))
        ids_b = iter(self.b.encode(real))
        all_a, all_b = [], []
        for text in texts:
            a, b = (next(ids_a), next(ids_b)) if text else ((), ())
            whole = b" " + text.encode() if text else b""
            same = b"".join(map(self.a.pieces.__getitem__, a)) == whole
            same = same and b"".join(map(self.b.pieces.__getitem__, b)) == whole
            all_a.append(np.array(a if same else (), np.int64))
            all_b.append(np.array(b if same else (), np.int64))
        return align_all(all_a, all_b, self.len_a, self.len_b)


def _aligner(path_a: str, path_b: str) -> Aligner:
    return once_per_process(
        f"aligner {path_a} {path_b}",
        lambda: Aligner(byte_tokenizer(path_a), piece_tokenizer(path_b)),
    )


def _chunks(texts: list[str | None], most: int) -> Iterator[slice]:
    """Runs of texts of about ``most`` characters; a longer text is one by itself."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text or "") > most:
            yield slice(start, i)
            start, size = i, 0
        size += len(text or "")
    if start < len(texts):
        yield slice(start, len(texts))


SMALL = 1 << 18  # characters given to the tokenizers at a time
DOCUMENT = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string"


def _align_task(path_a: str, path_b: str, id_type: pa.DataType, keep_groups: bool, most: int):
    """For documents: a row each with its links as indexes, and one a chunk with their pairs."""

    def emit(chunk: str, ids: pa.Array, texts: list[str | None]) -> pa.RecordBatch:
        aligner = _aligner(path_a, path_b)
        rows, links = [], []
        for part in _chunks(texts, SMALL):
            for found in aligner(texts[part]):
                text = written(found, aligner.names)
                digest = hashlib.sha256(text.encode()).hexdigest() if len(found.a) else ""
                sizes = (len(found.a), len(found.b), len(found.cuts_a), len(found.pairs))
                rows.append((*sizes, digest, text if keep_groups else None))
                links.append(found.pairs)
        pairs, index, counts = np.unique(
            np.concatenate(links), return_inverse=True, return_counts=True
        )
        packed = []
        for one in np.split(index, np.cumsum([len(x) for x in links])[:-1]):
            steps = np.diff(np.sort(one), prepend=0).astype("<u4")
            packed.append(zlib.compress(steps.tobytes(), 1))
        n = len(rows)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([chunk] * (n + 1)),
                pa.concat_arrays([ids, pa.nulls(1, id_type)]),
                *[pa.array([*column, None], kind) for column, kind in zip(
                    zip(*rows), [pa.int64()] * 4 + [pa.string()] * 2
                )],
                pa.array([*packed, None], pa.binary()),
                pa.array([None] * n + [pairs.tolist()], pa.list_(pa.int64())),
                pa.array([None] * n + [counts.tolist()], pa.list_(pa.int64())),
            ],
            ["chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups",
             "links", "pairs", "counts"],
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, n = TaskContext.get().partitionId(), 0
        ids, texts, size = [], [], 0
        for batch in batches:
            many = batch.column(1).to_pylist()
            for part in _chunks(many, most):
                more = sum(len(text or "") for text in many[part])
                if texts and size + more > most:
                    yield emit(f"{task}-{n}", pa.concat_arrays(ids), texts)
                    ids, texts, size, n = [], [], 0, n + 1
                ids.append(batch.column(0)[part.start : part.stop])
                texts.extend(many[part])
                size += more
        if texts:
            yield emit(f"{task}-{n}", pa.concat_arrays(ids), texts)

    return run


def _rank_task():
    """For rows sorted by chunk and place, header rows first: what a document's links count."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, parts, counts = None, [], None
        for batch in batches:
            names = batch.column("chunk")
            places = batch.column("place").to_numpy(zero_copy_only=False)
            values = batch.column("value").to_numpy(zero_copy_only=False)
            edges = pc.run_end_encode(names, run_end_type=pa.int32())
            start = 0
            keep, sums, bests = [], [], []
            for name, stop in zip(edges.values.to_pylist(), edges.run_ends.to_pylist()):
                if name != chunk:
                    chunk, parts, counts = name, [], None
                heads = start + int(np.searchsorted(places[start:stop], 1 << 40))
                parts.append(values[start:heads])
                if heads < stop and counts is None:
                    counts = np.concatenate(parts).astype(np.int64)
                for row in range(heads, stop):
                    steps = np.frombuffer(zlib.decompress(batch["links"][row].as_py()), "<u4")
                    found = counts[np.cumsum(steps, dtype=np.int64)]
                    keep.append(row)
                    sums.append(int((found >> 1).sum()))
                    bests.append(int((found & 1).sum()))
                start = stop
            if keep:
                rows = batch.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays(
                    [*[rows.column(c) for c in OUT], pa.array(bests, pa.int64()),
                     pa.array(sums, pa.int64())],
                    [*OUT, "n_best", "count_sum"],
                )

    return run


OUT = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups")


def alignments(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    path_a: str = BYTE_VOCABULARY,
    path_b: str = PIECE_VOCABULARY,
    keep_groups: bool = True,
    chunk: int = CHUNK,
) -> DataFrame:
    """One row per document: how its tokens under two vocabularies fit, and how usual that is.

    ``n_a`` and ``n_b`` tokens; ``n_groups`` spans of bytes at whose end tokens of both end,
    written in ``groups`` (null unless ``keep_groups``) and hashed; ``n_links`` pairs of tokens
    whose bytes overlap. The count of a pair of ids is how many links of all documents have it:
    ``count_sum`` adds it up over the document's links, ``n_best`` tells how many of these are of the
    pair, or one of the pairs, with the highest count among all with the same b. Texts that are null, empty or not spelt byte by byte
    by both vocabularies have zeros and ''. Whole texts count; repeated rows come back repeated
    and count each; no rows give no rows; other columns are ignored whatever their names.

    Links are counted per chunk of texts before they are shuffled: a task needs the counts of its
    own chunks' pairs only, and gets them by a join, so nothing is broadcast but the highest count
    of each id of b, which the vocabulary bounds. A chunk is
    ``chunk`` characters of text or a single text.
    """
    out = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = out.schema["doc_id"].dataType.simpleString()
    schema = (
        f"chunk string, doc_id {kind}, {DOCUMENT}, links binary, pairs array<long>, "
        "counts array<long>"
    )
    id_type = to_arrow_type(out.schema["doc_id"].dataType)
    task = _align_task(path_a, path_b, id_type, keep_groups, chunk)
    found = materialize(out.mapInArrow(task, schema), "alignments")
    listed = found.filter("links is null").select(
        "chunk", F.posexplode(F.arrays_zip("pairs", "counts")).alias("place", "at")
    ).select("chunk", "place", F.col("at.pairs").alias("pair"), F.col("at.counts").alias("n"))
    total = materialize(listed.groupBy("pair").agg(F.sum("n").alias("n")), "pair_counts")
    best = total.groupBy((F.col("pair") % IDS).alias("b")).agg(F.max("n").alias("most"))
    # The count, and in the last bit whether no pair of its b has a higher one.
    ranked = total.join(F.broadcast(best), F.col("pair") % IDS == F.col("b")).select(
        "pair", (F.col("n") * 2 + (F.col("n") == F.col("most")).cast("long")).alias("value")
    )
    none = [F.lit(None).cast(found.schema[c].dataType).alias(c) for c in (*OUT, "links")]
    heads = listed.join(ranked, "pair").select(
        "chunk", F.col("place").cast("long").alias("place"), "value", *none
    )
    rows = found.filter("links is not null").select(
        "chunk", F.lit(1 << 40).alias("place"), F.lit(None).cast("long").alias("value"), *OUT, "links"
    )
    both = heads.unionAll(rows).repartition("chunk").sortWithinPartitions("chunk", "place")
    return both.mapInArrow(
        _rank_task(), f"doc_id {kind}, {DOCUMENT}, n_best long, count_sum long"
    )
