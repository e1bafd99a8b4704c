import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from larder.llm import queries, repair

SCHEMA = "conv_id long, turn long, role string, text string"
LEGAL = {"su", "ua", "au"}


def faults(rows):
    """blank, duplicate, truncated or '' for each row, in order."""
    seen, found = set(), []
    for role, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]", text)
        if not words:
            found.append("blank")
        elif (role, text) in seen:
            found.append("duplicate")
        else:
            found.append("" if words[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return found


def every_edit(rows, inserted=2):
    """All ways to edit rows, with up to two insertions anywhere: cost, initials, repaired rows."""
    kinds = faults(rows)

    def go(i):
        gaps = [()] + [g for n in range(1, inserted + 1) for g in itertools.product("ua", repeat=n)]
        for gap in gaps:
            new = [({"u": "user", "a": "assistant"}[g], "") for g in gap]
            if i == len(rows):
                yield 2 * len(gap), "I" * len(gap), new
                continue
            role, text = rows[i]
            more = kinds[i] == "truncated"
            ways = [(3, "D", [])]
            if kinds[i] in ("", "truncated"):
                ways += [(more, "K", [rows[i]])]
                ways += [(2 + more, "R", [(r, text)]) for r in ("user", "assistant")]
            for cost, audit, out in go(i + 1):
                for c, letter, kept in ways:
                    yield 2 * len(gap) + c + cost, "I" * len(gap) + letter + audit, new + kept + out

    for cost, audit, out in go(0):
        if re.fullmatch("(s?(ua)+)?", "".join(r[:1] if r else "-" for r, _ in out)):
            yield cost, audit, out


def strings(rows):
    """The least cost and string by dynamic programming over whole strings."""
    best = {"": (0, "", [])}  # by the last role's initial

    def offer(new, state, value):
        if state not in new or value[:2] < new[state][:2]:
            new[state] = value

    def insert(best):
        new = dict(best)
        for _ in range(2):
            for state, (cost, audit, out) in list(new.items()):
                role = "assistant" if state == "u" else "user"
                offer(new, role[0], (cost + 2, audit + "I", [*out, (role, "")]))
        return new

    for (role, text), kind in zip(rows, faults(rows)):
        new = {}
        for state, (cost, audit, out) in insert(best).items():
            offer(new, state, (cost + 3, audit + "D", out))
            if kind in ("", "truncated"):
                more = kind == "truncated"
                wanted = "assistant" if state == "u" else "user"
                offer(new, wanted[0], (cost + 2 + more, audit + "R", [*out, (wanted, text)]))
                if role[:1] == wanted[0]:
                    offer(new, role[0], (cost + more, audit + "K", [*out, (role, text)]))
                if state == "" and role[:1] == "s":
                    offer(new, "s", (cost + more, audit + "K", [*out, (role, text)]))
        best = new
    last = insert(best)
    return min((last[s] for s in ("", "a") if s in last), key=lambda x: x[:2])


def random_rows(rng, n):
    roles = rng.choice([("user", "assistant"), ("user", "assistant", "system", "tool", "")])
    return [
        (rng.choice(roles), rng.choice(["Yes.", "No", " ", "Why?", "So", "Go!", "x."]) + rng.choice(["", "", str(i) + "."]))
        for i in range(n)
    ]


def solved(rows, segment=4096):
    kinds = faults(rows)
    facts = [(r[:1], k == "truncated", k in ("blank", "duplicate")) for (r, _), k in zip(rows, kinds)]
    parts = [facts[i : i + segment] for i in range(0, len(facts), segment)]
    tables = [repair.table(part, range(4) if i else (0,)) for i, part in enumerate(parts)]
    cost, ranks, more = repair.chain((c, r) for c, r, _ in tables)
    return cost, "".join(t[2][r] for t, r in zip(tables, ranks)) + "I" * more


def test_least_of_all_edits():
    rng = random.Random(4)
    for _ in range(60):
        rows = random_rows(rng, rng.randint(0, 4))
        expected = min(every_edit(rows, 1 if len(rows) > 3 else 2), key=lambda x: x[:2])
        assert strings(rows) == expected
        assert solved(rows) == expected[:2]


@pytest.mark.parametrize("segment", [1, 2, 3, 7, 4096])
def test_segments_make_no_difference(segment):
    rng = random.Random(segment)
    for _ in range(60):
        rows = random_rows(rng, rng.randint(1, 40))
        assert solved(rows, segment) == strings(rows)[:2]


def test_collisions_do_no_harm(monkeypatch):
    monkeypatch.setattr(repair, "MODULUS", 3)
    rng = random.Random(9)
    for _ in range(60):
        rows = random_rows(rng, rng.randint(1, 30))
        assert solved(rows, 11) == strings(rows)[:2]


def test_paths_compare_like_strings():
    rng, paths = random.Random(1), repair.Paths()
    nodes = [0]
    for _ in range(400):
        nodes.append(paths.add(rng.choice(nodes[-6:]), rng.choice("KRD")))
    whole = {n: "".join(paths.string(n)) for n in nodes}
    for _ in range(3000):
        p, q = rng.choice(nodes), rng.choice(nodes)
        x, y = rng.choice("KRDI"), rng.choice("KRDI")
        a, b = whole[p] + x, whole[q] + y
        if not a.startswith(b) and not b.startswith(a):
            assert paths.less(p, x, q, y) == (a < b)
        if len(whole[p]) > 3:
            assert whole[paths.ancestor(p, 3)] == whole[p][:3]


def slow(rows):
    """All conversations by hand; ``rows`` are conv_id, turn, role, text after damage."""
    whole = defaultdict(list)
    for conv_id, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
        whole[conv_id].append(((turn is not None, turn or 0, role.encode(), digest), turn, role, text))
    found = {}
    for conv_id, these in whole.items():
        these.sort(key=lambda r: r[0])
        turns = {t for _, t, *_ in these if t is not None}
        pairs = [(role, text) for *_, role, text in these]
        kinds = faults(pairs)
        initials = [r[:1] for r, _ in pairs]
        cost, audit, out = strings(pairs)
        found[conv_id] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            *(kinds.count(k) for k in ("blank", "duplicate", "truncated")),
            sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])),
            cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest(),
        )
    return found


def by_id(df):
    figures = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return {row["conv_id"]: tuple(row[f] for f in figures) for row in df.collect()}


def test_odd_conversations(spark):
    rows = [
        (1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 3, "assistant", "Hello!"),
        (2, None, "user", "One."), (2, None, "user", "One."), (2, 5, None, None), (2, 5, "", "x "),
        (3, 1, "user", ""), (4, 1, "system", "Only."), (None, 2, "assistant", "End.\n \x0b"),
        (None, 1, "user", "Go on"), (None, 1, "user", "Go on"), (None, 9, "user", "Go on"),
        (5, -(2**63), "user", "a."), (5, 2**63 - 1, "assistant", "b."),
        (6, 1, "user", "word " * 50_000), (6, 2, "assistant", "　."), (7, 1, "tool", "?"),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("audit", F.lit(1)).withColumn("part", F.lit(2))
    expected = slow(rows)
    expected[5] = (2**63 - 1, *expected[5][1:])  # more than a long holds
    for segment in (1, 4096):
        found = repair.audits(df.repartition(5), segment=segment)
        assert by_id(repair.digests(df, found)) == expected
    text = {}
    for row in sorted(repair.repaired(df, found).collect(), key=lambda r: r["place"]):
        text.setdefault(row["conv_id"], []).append(f"{row['role']}:{row['text']}")
    for conv_id, figures in expected.items():
        whole = "\n".join(text.get(conv_id, []))
        assert hashlib.sha256(whole.encode()).hexdigest() == figures[-1]


def test_one_conversation_over_many_tasks(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(8, i // 2, *row) for i, row in enumerate(random_rows(rng, 3000))]
    rows += [(8, 7, "user", "Again.")] * 500 + [(9, 1, "user", "Hi."), (9, 2, "assistant", "Yes.")]
    df = spark.createDataFrame(rows, SCHEMA)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = repair.audits(df, segment=100)
        assert by_id(repair.digests(df, found)) == slow(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_no_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    found = repair.audits(df)
    assert found.collect() == [] and repair.digests(df, found).collect() == []


def test_query(spark, sf="/root/testdata/sf0.001"):
    after, every = [], set()
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        conv_id, turn, role, text = (" " if r[c] is None else r[c] for c in ("conv_id", "turn", "role", "text"))
        every.add(r["conv_id"])
        fault = zlib.crc32(f"{conv_id}:{turn}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        after += [(r["conv_id"], r["turn"], role, text)] * {0: 0, 3: 2}.get(fault, 1)
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    expected = {conv_id: nothing for conv_id in every} | slow(after)
    assert by_id(queries.op11_repaired_conversations(spark, sf)) == expected
