"""Secrets by pattern, and random strings by how few characters a token of theirs holds."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import free_name, once_per_process, per_text

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed by the contract: the base patterns, and how many characters a match must have.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")  # of 16 characters or more
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex")
# What the token test looks at, and what it passes over.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
IDENTIFIER = re.compile(
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"  # UUID
    r"|[0-9+/_=-]++"  # numbers, dates and rules
    r"|(?:[A-Za-z]?[a-z]*+[A-Z]*+[0-9]{0,4}[+/_=-]++)++[A-Za-z]*+[0-9]{0,4}"  # names in parts
)
DIGEST = re.compile(r"(?:[0-9a-f]++|[0-9A-F]++)(?:==?)?")
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)  # hexadecimal digits of md5, sha1 and the sha2 family
# A digest behind its algorithm's name, as lock files, integrity attributes and archives write it.
NAMED = re.compile(r"(md5|sha-?(?:1|224|256|384|512))[-:=]([A-Za-z0-9+/_-]+={0,6})", re.IGNORECASE)
DIGEST_BYTES = {"md5": 16, "sha1": 20, "sha224": 28, "sha256": 32, "sha384": 48, "sha512": 64}
MOST_CHARS_A_TOKEN = 2.0
ONE_CASE = re.compile(r"[A-Za-z]?[a-z]++|[A-Z]++")
ONE_CASE_SHARE = 0.95  # of the limit, for what may be a long compound word
WINDOW = 20  # characters tested at a time within a run that is not random as a whole
PART = re.compile(r"[A-Za-z0-9]+")
UUID = re.compile(r"(?<![A-Za-z0-9])[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?![A-Za-z0-9])")
PIECE = 256  # characters encoded at a time


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Kind, start and end of what the base patterns match, by start, then kind as listed."""
    found = []
    lower = text.lower()
    if any(word in lower for word in ("passw", "secret", "token", "api")):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 8:
                found.append((m.start(), 0, m.end()))
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= 16:
                found.append((m.start(), 1, m.end()))
    for m in HEX.finditer(text):
        found.append((m.start(), 2, m.end()))
    return [(KINDS[kind], start, end) for start, kind, end in sorted(found)]


def encoder(ranks: dict[bytes, int], pattern: str) -> Callable[[str], list[int]]:
    import tiktoken

    encoding = tiktoken.Encoding(
        "own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}
    )
    return encoding.encode_ordinary


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """The ranks of a tiktoken vocabulary: a line each of a token in base64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def chars_a_token(candidate: str, encode: Callable[[str], list[int]]) -> float:
    tokens = sum(len(encode(candidate[i : i + PIECE])) for i in range(0, len(candidate), PIECE))
    return len(candidate) / tokens


def is_known(candidate: str) -> bool:
    """Whether it is a digest or an identifier by its form."""
    if IDENTIFIER.fullmatch(candidate):
        return True
    return len(candidate) in DIGEST_LENGTHS and bool(DIGEST.fullmatch(candidate))


def is_random(candidate: str, encode: Callable[[str], list[int]], most: float) -> bool:
    if is_known(candidate):
        return False
    share = ONE_CASE_SHARE if ONE_CASE.fullmatch(candidate) else 1.0
    return chars_a_token(candidate, encode) < share * most


def random_parts(
    run: str, encode: Callable[[str], list[int]], most: float
) -> list[tuple[int, int]]:
    """Starts and ends of what is random in a run: all of it, or else parts and windows of it.

    A part is what stands between two of +/_=-. Between the UUIDs, digests and random parts, every
    window of ``WINDOW`` characters is tried, as a secret may hold +/_=- or adjoin a word.
    """
    if is_random(run, encode, most):
        return [(0, len(run))]
    found, passed = [], [m.span() for m in UUID.finditer(run)]
    for m in PART.finditer(run):
        if m.end() - m.start() < WINDOW or any(a <= m.start() < b for a, b in passed):
            continue
        if is_random(m.group(), encode, most):
            found.append(m.span())
        elif is_known(m.group()):
            passed.append(m.span())
    if not is_known(run) and not ONE_CASE.fullmatch(run):
        gaps = sorted(found + passed)
        for low, high in zip([0, *(b for _, b in gaps)], [*(a for a, _ in gaps), len(run)]):
            for at in range(low, high - WINDOW + 1):
                if is_random(run[at : at + WINDOW], encode, most):
                    if found and low <= found[-1][0] and at <= found[-1][1] and found[-1][1] <= high:
                        found[-1] = (found[-1][0], at + WINDOW)
                    else:
                        found.append((at, at + WINDOW))
    return sorted(found)


def uncovered(
    start: int, end: int, base: list[tuple[str, int, int]], at: int, text: str
) -> list[tuple[int, int]]:
    """What the base spans from the one at ``at`` leave of a run, if of 20 characters or more."""
    left, low = [], start
    while at < len(base) and base[at][1] < end:
        left.append((low, base[at][1]))
        low = max(low, base[at][2])
        at += 1
    left.append((low, end))
    cut = []
    for a, b in left:
        while a != start and a < b and text[a] in "+/_=-":
            a += 1
        while b != end and a < b and text[b - 1] in "+/_=-":
            b -= 1
        if b - a >= WINDOW:
            cut.append((a, b))
    return cut


def named_digests(text: str) -> list[tuple[str, int, int]]:
    """Where the text has an algorithm's name and a value as long as its digest.

    In hexadecimal, base32 or base64, with or without padding.
    """
    lower = text.lower()
    if "sha" not in lower and "md5" not in lower:
        return []
    found = []
    for m in NAMED.finditer(text):
        size = DIGEST_BYTES[m.group(1).lower().replace("-", "")]
        value = m.group(2).rstrip("=")
        padded = len(m.group(2))
        lengths = {2 * size, -(-8 * size // 5), -(-4 * size // 3)}
        if len(value) in lengths and padded in (len(value), 8 * -(-size // 5), 4 * -(-size // 3)):
            found.append(("digest", m.start(), m.end()))
    return found


def spans(
    text: str, encode: Callable[[str], list[int]], most: float = MOST_CHARS_A_TOKEN
) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """The base spans, and all spans: with those of kind ``random``, which overlap no base span."""
    base = base_spans(text)
    passed = sorted(base + named_digests(text), key=lambda s: s[1])
    more, at = [], 0
    for m in CANDIDATE.finditer(text):
        while at < len(passed) and passed[at][2] <= m.start():
            at += 1
        for start, end in uncovered(m.start(), m.end(), passed, at, text):
            for low, high in random_parts(text[start:end], encode, most):
                more.append(("random", start + low, start + high))
    order = {kind: i for i, kind in enumerate((*KINDS, "random"))}
    return base, sorted(base + more, key=lambda s: (s[1], order[s[0]], s[2]))


def written(found: Iterable[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in found)


def find(
    docs: DataFrame,
    text: str = "text",
    vocabulary: str = VOCABULARY,
    most: float = MOST_CHARS_A_TOKEN,
) -> Column:
    """A column of ``docs`` with the secrets of each whole text.

    A struct: ``base`` and ``all``, arrays of ``kind``, ``start`` and ``end`` (code points, end
    exclusive), by start, then kind. The base patterns find assignments, access keys and long
    hexadecimal runs. What these leave of a run of 20 or more letters, digits and +/_=- is
    ``random`` besides if it has 20 characters or more, its tokens hold fewer than ``most``
    characters each and it has not the form of a digest or an identifier; digests in base32 or
    base64 are known by the name of their algorithm before them. If it is not random as
    a whole, so is each part of 20 or more between +/_=- and each window of 20 characters; windows
    are not tried in what has the form of names in parts or of one word. Letters in one case have a
    limit of ``ONE_CASE_SHARE`` of ``most``. Nulls and empty texts have no spans. Each row stands for
    itself: repeated rows get the same, no rows give none, ids may be null, and other columns are
    not looked at.

    The driver reads the vocabulary, of about a megabyte, and broadcasts it.
    """
    import public_tokenizers

    session = docs.sparkSession
    shared = session.sparkContext.broadcast((read_ranks(vocabulary), public_tokenizers.PATTERN))
    name = f"encoder {vocabulary}"

    def compute(texts: list[bytes]) -> Iterable[tuple]:
        encode = once_per_process(name, lambda: encoder(*shared.value))
        keys = ("kind", "start", "end")
        for raw in texts:
            base, everything = spans(raw.decode(), encode, most)
            yield [dict(zip(keys, s)) for s in base], [dict(zip(keys, s)) for s in everything]

    span = "array<struct<kind: string, start: int, end: int>>"
    return per_text(compute, f"base {span}, all {span}")(docs[text])


def masked(text: str, found: list[dict]) -> str:
    """A text with each span replaced by its kind in angle brackets; overlaps become one."""
    kept, start = [], 0
    for s in sorted(found, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= start:
            kept += [text[start : s["start"]], f"<{s['kind']}>"]
        start = max(start, s["end"])
    return "".join(kept) + text[start:]


def _mask(texts: pa.Array, found: pa.Array) -> pa.Array:
    return pa.array(map(masked, texts.to_pylist(), found.to_pylist()), pa.string())


_mask.__annotations__ = {k: pa.Array for k in ("texts", "found", "return")}


def mask(docs: DataFrame, text: str = "text", **how) -> DataFrame:
    """``docs`` with the secrets in ``text`` replaced by ``<kind>``; nulls stay null."""
    name = free_name(docs, "_secrets")
    hidden = F.arrow_udf(_mask, "string")(F.coalesce(F.col(text), F.lit("")), F.col(name)["all"])
    found = docs.withColumn(name, find(docs, text, **how))
    return found.withColumn(
        text, F.when(F.size(F.col(name)["all"]) > 0, hidden).otherwise(F.col(text))
    ).drop(name)
