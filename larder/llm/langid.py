"""Language by unigram pieces over a public vocabulary, summed over all segmentations."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Sequence
from typing import NamedTuple

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import once_per_process, per_text, remainder

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
START = "▁"  # fixed by the vocabulary: marks the start of a word in a piece
FOLDS, HELD_OUT = 4, 2
MOST_TEXTS = 500  # texts per language that are learned from, at most
MOST_WORDS = 200_000  # words with their languages that are learned from, at most
MOST_LANGUAGES = 1000  # languages that are told apart, at most: the first by name
LONGEST_PIECE = 10
BLOCK = 40  # letters of a word scored together; longer ones are scored in blocks of so many
PART = 1 << 20  # characters whose words are held at a time
LETTERS = re.compile(r"[^\W\d_]+")
NO_LETTER = re.compile(r"[\W\d_]")
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)  # any large odd number


class Model(NamedTuple):
    languages: list[str]
    hashes: np.ndarray  # of the known pieces, sorted
    logs: np.ndarray  # pieces x languages; the last row is for any unknown letter
    longest: int


def read_pieces(path: str = VOCABULARY) -> list[str]:
    """The pieces of the public vocabulary that consist of lower-case letters."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    known = {p for p in pieces if p.lstrip(START).isalpha() and p == p.lower()}
    return sorted(p for p in known if len(p) <= LONGEST_PIECE)


def spread(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the marked words, a row each, padded with 0; and their lengths."""
    lengths = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
    codes = np.zeros((len(words), int(lengths.max(initial=1))), np.uint64)
    filled = np.arange(codes.shape[1]) < lengths[:, None]
    joined = "".join(START + w for w in words)
    codes[filled] = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    return codes, lengths


def piece_hashes(codes: np.ndarray, at: int, longest: int) -> Iterable[tuple[int, np.ndarray]]:
    """For each length, the hash of the letters of that number that end before ``at``."""
    total = np.zeros(len(codes), np.uint64)
    for length in range(1, min(longest, at) + 1):
        total = (total ^ codes[:, at - length]) * MULTIPLIER
        total ^= total >> np.uint64(31)
        yield length, total


def hash_pieces(pieces: Sequence[str]) -> np.ndarray:
    found = np.zeros(len(pieces), np.uint64)
    by_length: dict[int, list[int]] = {}
    for i, piece in enumerate(pieces):
        by_length.setdefault(len(piece), []).append(i)
    for length, rows in by_length.items():
        joined = "".join(pieces[i] for i in rows)
        codes = np.frombuffer(joined.encode("utf-32-le"), "<u4").astype(np.uint64)
        for size, total in piece_hashes(codes.reshape(-1, length), length, length):
            if size == length:
                found[rows] = total
    return found


class Table:
    """Finds hashes in an array of them, by open addressing; far faster here than a search."""

    def __init__(self, hashes: np.ndarray, bits: int = 18):
        self.hashes = np.r_[hashes, np.uint64(0)]
        self.none = len(hashes)
        self.mask = np.uint64((1 << max(bits, len(hashes).bit_length() + 2)) - 1)
        self.slots = np.full(int(self.mask) + 1, self.none, np.int32)
        for i, key in enumerate(hashes.tolist()):
            at = key & int(self.mask)
            while self.slots[at] != self.none:
                at = (at + 1) & int(self.mask)
            self.slots[at] = i

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key, or the number of hashes where there is none."""
        found = self.slots[keys & self.mask]
        clash = np.flatnonzero((self.hashes[found] != keys) & (found != self.none))
        step = np.uint64(0)
        while len(clash):
            step += np.uint64(1)
            found[clash] = self.slots[(keys[clash] + step) & self.mask]
            again = (self.hashes[found[clash]] != keys[clash]) & (found[clash] != self.none)
            clash = clash[again]
        return found


def lattice(codes: np.ndarray, lengths: np.ndarray, table: Table, longest: int) -> list:
    """The pieces that end at each place: for each place, lists of (length, rows, piece).

    Unknown single letters are taken as the piece after the last, so every word has a path.
    """
    ends = []
    for at in range(1, codes.shape[1] + 1):
        arcs = []
        inside = np.flatnonzero(lengths >= at)
        for length, total in piece_hashes(codes[inside], at, longest):
            piece = table.find(total)
            if length == 1:
                arcs.append((1, inside, piece))
            else:
                known = np.flatnonzero(piece != table.none)
                if len(known):
                    arcs.append((length, inside[known], piece[known]))
        ends.append(arcs)
    return ends


def word_logs(words: Sequence[str], model: Model, table: Table) -> np.ndarray:
    """Log probability of each word in each language: the forward sum over segmentations."""
    out = np.zeros((len(words), len(model.languages)))
    order = np.argsort([len(w) for w in words], kind="stable")
    chances = np.exp(model.logs)
    for low in range(0, len(order), 20_000):  # words of like length together
        rows = order[low : low + 20_000]
        codes, lengths = spread([words[i] for i in rows])
        # forward[p] is the probability of the first p letters; a letter is worth a factor of
        # about 1/10, so words of up to BLOCK letters stay far from underflow.
        forward = np.zeros((codes.shape[1] + 1, len(rows), len(model.languages)))
        forward[0] = 1.0
        for at, arcs in enumerate(lattice(codes, lengths, table, model.longest), 1):
            for length, at_rows, pieces in arcs:
                forward[at, at_rows] += forward[at - length, at_rows] * chances[pieces]
        out[rows] = np.log(forward[lengths, np.arange(len(rows))])
    return out


def learn(counts: dict[str, Counter], pieces: Sequence[str], rounds: int = 4) -> Model | None:
    """Piece probabilities per language by expectation maximisation over all segmentations.

    ``counts`` has the words of each language. Every piece keeps a small probability in every
    language, and an unknown letter a smaller one.
    """
    languages = sorted(lang for lang, words in counts.items() if words)
    if not languages:
        return None
    words = sorted(set().union(*(counts[lang] for lang in languages)))
    hashes = hash_pieces(pieces)
    order = np.argsort(hashes)
    hashes = hashes[order]
    table = Table(hashes)
    longest = max(map(len, pieces))
    weight = np.array([[counts[lang][w] for lang in languages] for w in words], float)
    expected = np.full((len(pieces) + 1, len(languages)), 1.0)
    for _ in range(rounds):
        smoothed = expected + 0.1 * expected.sum(axis=0) / 1e6
        smoothed[-1] = expected[-1] + expected.sum(axis=0) / 1e5
        chances = smoothed / smoothed.sum(axis=0)
        expected = np.zeros_like(expected)
        by_length = np.argsort([len(w) for w in words], kind="stable")
        for low in range(0, len(words), 20_000):
            rows = by_length[low : low + 20_000]
            codes, lengths = spread([words[i] for i in rows])
            ends = lattice(codes, lengths, table, longest)
            forward = np.zeros((codes.shape[1] + 1, len(rows), len(languages)))
            forward[0] = 1.0
            for at, arcs in enumerate(ends, 1):
                for length, at_rows, found in arcs:
                    forward[at, at_rows] += forward[at - length, at_rows] * chances[found]
            total = forward[lengths, np.arange(len(rows))]
            backward = np.zeros_like(forward)
            backward[lengths, np.arange(len(rows))] = weight[rows] / total
            for at in range(len(ends), 0, -1):
                for length, at_rows, found in ends[at - 1]:
                    flow = chances[found] * backward[at, at_rows]
                    backward[at - length, at_rows] += flow
                    flow *= forward[at - length, at_rows]
                    for k in range(len(languages)):
                        expected[:, k] += np.bincount(
                            found, weights=flow[:, k], minlength=len(expected)
                        )
    smoothed = expected + 0.1 * expected.sum(axis=0) / 1e6
    smoothed[-1] = expected[-1] + expected.sum(axis=0) / 1e5
    return Model(languages, hashes, np.log(smoothed / smoothed.sum(axis=0)), longest)


def blocks_of(word: str) -> list[str]:
    return [word[i : i + BLOCK] for i in range(0, len(word), BLOCK)]


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case, long ones in blocks."""
    found = LETTERS.findall(text.lower())
    if any(len(w) > BLOCK for w in found):
        return [part for w in found for part in blocks_of(w)]
    return found


def parts_of(text: str, size: int = PART) -> Iterable[str]:
    """A text in parts of about ``size`` characters, parted where no word is cut."""
    low = 0
    while low < len(text):
        between = NO_LETTER.search(text, low + size)
        high = between.end() if between else len(text)
        yield text[low:high]
        low = high


class Scorer:
    """Scores texts and keeps the words it has met, up to a bound."""

    def __init__(self, model: Model, most_words: int = 250_000):
        self.model, self.most_words = model, most_words
        self.table = Table(model.hashes)
        self.rows: dict[str, int] = {}
        self.logs = np.zeros((0, len(model.languages)))

    def predict(self, texts: Sequence[bytes]) -> list[tuple[str, float]]:
        """The language and its posterior for each text.

        The evidence of a text's words is added up, and weighed as that of 20 words at most, so
        that the posterior of a long text in a mix of languages isn't 1 at once. Words are held
        for about ``PART`` characters of texts at a time.
        """
        totals = np.zeros((len(texts), len(self.model.languages)))
        counts = np.zeros(len(texts), np.int64)
        letters = np.zeros(len(texts), bool)
        held: list[tuple[int, list[str]]] = []
        size = 0
        for i, raw in enumerate(texts):
            for part in parts_of(raw.decode("utf-8", "replace")):
                words = words_of(part)
                counts[i] += len(words)
                letters[i] |= any(map(str.isalpha, words)) or any(c.isalpha() for c in part)
                held.append((i, words))
                size += len(part)
                if size > PART:
                    self._add(held, totals)
                    held, size = [], 0
        self._add(held, totals)
        totals *= np.minimum(1.0, 20 / np.maximum(counts, 1))[:, None]
        chances = np.exp(totals - totals.max(axis=1, keepdims=True))
        chances /= chances.sum(axis=1, keepdims=True)
        best = chances.argmax(axis=1)
        return [
            (self.model.languages[k], float(chances[i, k])) if letters[i] else ("und", 0.0)
            for i, k in enumerate(best)
        ]

    def _add(self, held: list[tuple[int, list[str]]], totals: np.ndarray) -> None:
        met = set().union(*(words for _, words in held))
        if len(self.rows) + len(met) > self.most_words:
            self.rows, self.logs = {}, self.logs[:0]
        new = sorted(met.difference(self.rows))
        self.rows.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))
        self.logs = np.concatenate([self.logs, word_logs(new, self.model, self.table)])
        for i, words in held:
            if words:
                totals[i] += self.logs[[self.rows[w] for w in words]].sum(axis=0)


def training_words(
    docs: DataFrame,
    most_texts: int = MOST_TEXTS,
    most_words: int = MOST_WORDS,
    most_languages: int = MOST_LANGUAGES,
) -> dict[str, Counter]:
    """The words of each language in the learning rows, counted on the executors.

    ``most_texts`` texts of each language are read, those of the least hashes of their ids; of
    their words the ``most_words`` commonest are returned. The hashes are narrowed down in 64 parts
    of a language first, so at most 64 times ``most_texts`` of them meet in a task.
    """
    known = (remainder(F.col("doc_id"), FOLDS) != HELD_OUT) & F.col("lang").isNotNull()
    mark = F.xxhash64("doc_id")
    least = docs.filter(known).select(
        "lang", mark.alias("mark"), F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(64)).alias("part")
    )
    for group in (["lang", "part"], ["lang"]):  # so that no task meets all of a common language
        order = Window.partitionBy(*group).orderBy("mark")
        least = least.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= most_texts)
    chosen = (
        least.groupBy("lang")
        .agg(F.max("mark").alias("upto"))
        .orderBy("lang")
        .limit(most_languages)
    )

    def compute(texts: list[bytes]) -> Iterable[tuple]:
        return ((words_of(t.decode("utf-8", "replace")),) for t in texts)

    rows = docs.filter(known).select("lang", "text", mark.alias("mark"))
    words = (
        rows.join(F.broadcast(chosen), "lang")
        .filter(F.col("mark") <= F.col("upto"))
        .select("lang", per_text(compute, "words array<string>")(F.col("text"))["words"].alias("w"))
        # A plain explode adds a filter that would have all texts parted before the join.
        .select("lang", F.explode_outer("w").alias("word"))
        .filter("word is not null")
    )
    counted = words.groupBy("lang", "word").count()
    top = counted.orderBy(F.desc("count"), "lang", "word").limit(most_words)
    counts: dict[str, Counter] = {}
    for lang, word, count in top.collect():
        counts.setdefault(lang, Counter())[word] = count
    return counts


def train(docs: DataFrame, vocabulary: str = VOCABULARY, **bounds: int) -> Model | None:
    """A model from the texts of ``docs`` with a language, outside the held-out fold.

    None if there is no such text with a word. The vocabulary's file is read by the driver.
    """
    return learn(training_words(docs, **bounds), read_pieces(vocabulary))


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> Column:
    """A column with ``lang_pred`` and ``score``, from 0 to 1, of each whole text.

    ``und`` with score 0 for nulls and for texts without a letter, and for all without a model. Of
    equally likely languages the first by name is predicted. Each row stands for itself: repeated
    rows get the same, no rows give none, and other columns, ids and languages among them, are
    not looked at.
    """

    def compute(texts: list[bytes]) -> Iterable[tuple]:
        if model is None:
            return [("und", 0.0)] * len(texts)
        name = f"languages {name_of(model)}"
        return once_per_process(name, lambda: Scorer(model)).predict(texts)

    return per_text(compute, "lang_pred string, score double")(docs[text])


def name_of(model: Model) -> str:
    """A name for a model, by its content."""
    return xxhash.xxh64_hexdigest(model.logs.tobytes() + model.hashes.tobytes())
