"""Personal data by pattern, and by a character-level bidirectional LSTM with CRF transitions."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm import tagger
from larder.llm.common import free_name, per_text

KINDS = ("email", "ip", "card", "phone")
# Fixed by the contract. The local part and its @ are looked for by hand, in linear time.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"[0-9]++(?:\.([0-9]++)\.([0-9]++)\.([0-9]++))?")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
SOUGHT = re.compile(r"[0-9@]")  # one of these is in every span of every kind
WINDOW, STRIDE = 128, 64
MOST_TEXTS = 3000  # texts that labelled spans are taken from, at most
PER_TEXT = 6  # windows of a text that are learned from, at most


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def is_card(text: str) -> bool:
    digits = digits_of(text)
    return 13 <= len(digits) <= 19 and luhn(digits)


def is_byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def emails(text: str) -> Iterable[tuple[int, int]]:
    """Matches of the email pattern, each found from its @: linear even in long odd texts."""
    after = 0  # the end of the match before
    at = text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            after = domain.end()
        else:
            after = max(after, at)  # letters before this @ belong to no later local part
        at = text.find("@", max(at + 1, after))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Kind, start and end of what the base patterns match, by kind as listed, then start."""
    found = [("email", *span) for span in emails(text)]
    if not DIGIT.search(text):
        return found
    for m in IP.finditer(text):
        if m[1] is not None:
            first = m.group().split(".", 1)[0]
            if all(map(is_byte, (first, m[1], m[2], m[3]))):
                found.append(("ip", m.start(), m.end()))
    found += [("card", *m.span()) for m in CARD.finditer(text) if is_card(m.group())]
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(digits_of(m.group())) <= 15:
                found.append(("phone", *m.span()))
    return found


def windows_of(text: str) -> list[int]:
    """Starts of the windows with a digit or an @; the others can't hold any of the four kinds."""
    places = {m.start() // STRIDE for m in SOUGHT.finditer(text)}
    starts = {b for place in places for b in (place - 1, place) if b >= 0}
    last = max(0, -(-(len(text) - WINDOW) // STRIDE))
    return sorted({min(b, last) * STRIDE for b in starts})


def plausible(kind: str, text: str) -> bool:
    """The check that follows the model: whether a span can be what it is tagged as."""
    digits = digits_of(text)
    if kind == "email":
        local, _, domain = "".join(text.split()).partition("@")
        return bool(local) and DOMAIN.fullmatch(domain) is not None
    if kind == "ip":
        parts = re.split(r"[^0-9]+", text)
        return len(parts) == 4 and all(p and is_byte(p) for p in parts)
    if kind == "card":
        return is_card(text) and not re.search(r"[A-Za-z]", text)
    return 10 <= len(digits) <= 15 and re.fullmatch(r"[0-9\x20().+/-]+", text) is not None


def reconcile(candidates: Iterable[tuple[str, int, int, float]]) -> list[tuple[str, int, int]]:
    """Of the spans that all windows of a text propose, those without overlap of most weight.

    The same span from two windows counts once, with its greater weight. This is weighted
    interval scheduling: exact, and near linear in the proposals.
    """
    best: dict[tuple[str, int, int], float] = {}
    for kind, start, end, weight in candidates:
        best[kind, start, end] = max(weight, best.get((kind, start, end), 0.0))
    spans = sorted(best.items(), key=lambda x: (x[0][2], x[0][1], x[0][0]))
    ends = [end for (_, _, end), _ in spans]
    totals, taken = [0.0], []
    for i, ((_, start, _), weight) in enumerate(spans):
        before = int(np.searchsorted(ends[:i], start, side="right"))
        with_it = totals[before] + weight
        taken.append((with_it > totals[i], before))
        totals.append(max(with_it, totals[i]))
    chosen, i = [], len(spans)
    while i:
        take, before = taken[i - 1]
        if take:
            chosen.append(spans[i - 1][0])
        i = before if take else i - 1
    return chosen[::-1]


def find_spans(texts: Sequence[str], model: dict) -> list[tuple[list, list]]:
    """For each text the base spans and those that the model adds, which overlap no base span."""
    base = [base_spans(t) for t in texts]
    places = [(i, start) for i, t in enumerate(texts) for start in windows_of(t)]
    proposed: dict[int, list] = {}
    for low in range(0, len(places), 1024):
        part = places[low : low + 1024]
        codes = tagger.encode([texts[i][start : start + WINDOW] for i, start in part], WINDOW)
        for (i, start), spans in zip(part, tagger.decode(model, codes)):
            text = texts[i]
            for kind, a, b, weight in spans:
                a, b = start + a, start + b
                # A span that runs out of its window is whole in the next one.
                if b > len(text) or (a == start and a) or (b == start + WINDOW < len(text)):
                    continue
                proposed.setdefault(i, []).append((KINDS[kind], a, b, weight))
    out = []
    for i, text in enumerate(texts):
        covered = sorted((a, b) for _, a, b in base[i])
        more = [
            span
            for span in reconcile(proposed.get(i, ()))
            if plausible(span[0], text[span[1] : span[2]])
            and not any(a < span[2] and span[1] < b for a, b in covered)
            and not text[span[1] - 1 : span[1]].isalnum()
            and not text[span[2] : span[2] + 1].isalnum()
        ]
        out.append((base[i], more))
    return out


def examples(text: str) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Some windows of a text, with the base spans that are whole in them."""
    starts = windows_of(text)[:PER_TEXT] or [0]
    base = base_spans(text)
    found = []
    for start in starts:
        end = start + WINDOW
        inside = [(KINDS.index(k), a - start, b - start) for k, a, b in base if a >= start and b <= end]
        cut = any(a < end and b > start and not (a >= start and b <= end) for _, a, b in base)
        if not cut:
            found.append((text[start:end], inside))
    return found


def train(docs: DataFrame, text: str = "text", most_texts: int = MOST_TEXTS, **how) -> dict:
    """A model from labelled spans: those of the base patterns in ``most_texts`` texts.

    The texts are those with the least hashes of their ids. Their windows are collected, a few
    hundred kilobytes, and varied by `tagger.vary`: spans are also written in other formats and
    mixed with what is no personal data. Training is repeatable.
    """
    mark = F.xxhash64("doc_id")
    least = docs.select(mark.alias("mark")).orderBy("mark").limit(most_texts)
    upto = least.agg(F.max("mark").alias("m")).first().m

    def compute(texts: list[bytes]) -> Iterable[tuple]:
        for t in texts:
            made = examples(t.decode())
            yield ([{"t": w, "s": [{"k": k, "a": a, "b": b} for k, a, b in s]} for w, s in made],)

    schema = "found array<struct<t: string, s: array<struct<k: int, a: int, b: int>>>>"
    chosen = docs.filter(mark <= F.lit(upto)) if upto is not None else docs.limit(0)
    rows = chosen.select(F.explode_outer(per_text(compute, schema)(F.col(text))["found"]).alias("w"))
    bound = most_texts * PER_TEXT
    got = [
        (r.w.t, [(s.k, s.a, s.b) for s in r.w.s]) for r in rows.filter("w is not null").limit(bound).toLocalIterator()
    ]
    return tagger.train(sorted(got), KINDS, WINDOW, **how)


def find(docs: DataFrame, model: dict, text: str = "text") -> Column:
    """A column of ``docs`` with the personal data of each whole text.

    A struct: ``base``, what the base patterns match, and ``more``, what the model adds, arrays
    of ``kind``, ``start`` and ``end`` (code points, end exclusive) by kind as listed, then
    start. Nulls and empty texts have no spans. Windows of 128 characters that overlap by half
    are tagged wherever there is a digit or an @, as every span has one; what they propose is
    reconciled over the whole text, and checked. Of proposals of equal weight those that end first
    are kept. Each row stands for itself: repeated rows get the same, no rows give none, ids may
    be null, and other columns are not looked at.
    """

    def compute(texts: list[bytes]) -> Iterable[tuple]:
        keys = ("kind", "start", "end")
        order = {kind: i for i, kind in enumerate(KINDS)}
        for base, more in find_spans([t.decode() for t in texts], model):
            more.sort(key=lambda s: (order[s[0]], s[1]))
            yield [dict(zip(keys, s)) for s in base], [dict(zip(keys, s)) for s in more]

    span = "array<struct<kind: string, start: int, end: int>>"
    return per_text(compute, f"base {span}, more {span}")(docs[text])


def masked(text: str, found: Sequence[dict]) -> str:
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


def mask(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """``docs`` with the personal data in ``text`` replaced by ``<kind>``; nulls stay null."""
    name = free_name(docs, "_personal")
    both = F.concat(F.col(name)["base"], F.col(name)["more"])
    hidden = F.arrow_udf(_mask, "string")(F.coalesce(F.col(text), F.lit("")), both)
    found = docs.withColumn(name, find(docs, model, text))
    return found.withColumn(text, F.when(F.size(both) > 0, hidden).otherwise(F.col(text))).drop(name)
