"""Repair of conversations: the cheapest edits that make turns alternate, by a persistent audit DP."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from larder.sources.tables import materialize

# Fixed by the contract: what an edit costs, and by its initial which of equal strings is least.
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
TRUNCATED_COST = 1  # of a truncated row that is not deleted
ROLES = ("user", "assistant")
LEGAL = ("su", "ua", "au")
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
SOUND, TRUNCATED, BLANK = 0, 1, 2
# Where a repaired conversation stands: nothing yet, or its last row's role.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
BEFORE_USER = (NOTHING, SYSTEM, ASSISTANT)
SEGMENT = 4096  # rows of a conversation that one table of costs covers
MODULUS, BASE = (1 << 61) - 1, 0x1B873593_9E3779B1 % ((1 << 61) - 1)
LONG = (1 << 63) - 1


class Paths:
    """Strings that share their prefixes. A string is a node: its parent's string and a symbol.

    A node knows its ancestors at distances 1, 2, 4 and so on and the rolling hash of its string,
    so the longest common prefix of two strings is found in a logarithmic number of steps.
    """

    def __init__(self) -> None:
        self.symbols: list = [None]
        self.depths = [0]
        self.hashes = [0]
        self.ups: list[tuple[int, ...]] = [()]

    def add(self, parent: int, symbol) -> int:
        ups, at = [parent], 0
        while at < len(self.ups[ups[at]]):
            ups.append(self.ups[ups[at]][at])
            at += 1
        self.ups.append(tuple(ups))
        self.symbols.append(symbol)
        self.depths.append(self.depths[parent] + 1)
        code = symbol + 1 if isinstance(symbol, int) else ord(symbol)
        self.hashes.append((self.hashes[parent] * BASE + code) % MODULUS)
        return len(self.symbols) - 1

    def ancestor(self, node: int, depth: int) -> int:
        """The node of the first ``depth`` symbols of a string."""
        far = self.depths[node] - depth
        while far:
            step = far.bit_length() - 1
            node = self.ups[node][step]
            far -= 1 << step
        return node

    def fork(self, p: int, q: int) -> tuple[int, int]:
        """The nodes of the first symbols at which strings of equal length differ.

        Equal strings give equal nodes or, if they were added twice, (0, 0). What lies before
        the place that the hashes tell is compared symbol by symbol up to the first node that both
        share, so that equal hashes of different strings do no harm.
        """
        if p == q:
            return 0, 0
        if self.hashes[p] != self.hashes[q]:
            for step in reversed(range(len(self.ups[p]))):
                if step < len(self.ups[p]):
                    a, b = self.ups[p][step], self.ups[q][step]
                    if self.hashes[a] != self.hashes[b]:
                        p, q = a, b
            a, b, found = self.ups[p][0], self.ups[q][0], (p, q)
        else:
            a, b, found = p, q, (0, 0)
        while a != b:  # a shared node proves the prefix equal
            if self.symbols[a] != self.symbols[b]:
                found = a, b
            a, b = self.ups[a][0], self.ups[b][0]
        return found

    def less(self, p: int, x, q: int, y) -> bool:
        """Whether the string of p with x behind it comes before that of q with y behind it."""
        depth = min(self.depths[p], self.depths[q])
        a, b = self.fork(self.ancestor(p, depth), self.ancestor(q, depth))
        if a != b:
            return self.symbols[a] < self.symbols[b]
        if self.depths[p] > depth:
            x = self.symbols[self.ancestor(p, depth + 1)]
        elif self.depths[q] > depth:
            y = self.symbols[self.ancestor(q, depth + 1)]
        return x < y

    def string(self, node: int) -> list:
        symbols = []
        while node:
            symbols.append(self.symbols[node])
            node = self.ups[node][0]
        return symbols[::-1]


Cells = list  # by state: None, or the least cost and its least string's node


def _offer(paths: Paths, best: list, state: int, cost: int, parent: int, symbol) -> None:
    """Let a string compete for a state; equal costs go to the string that comes first."""
    old = best[state]
    if old is None or cost < old[0]:
        best[state] = (cost, parent, symbol)
    elif cost == old[0] and paths.less(parent, symbol, old[1], old[2]):
        best[state] = (cost, parent, symbol)


def _settle(paths: Paths, best: list) -> Cells:
    return [None if x is None else (x[0], paths.add(x[1], x[2])) for x in best]


def _inserted(paths: Paths, cells: Cells) -> Cells:
    """What can be reached by inserting empty rows: a user's, then an assistant's.

    A longer run of inserted rows ends where a shorter one does.
    """
    reached = list(cells)
    for target, sources in ((USER, BEFORE_USER), (ASSISTANT, (USER,))):
        best: list = [None] * 4
        for state in sources:
            if reached[state] is not None:
                cost, node = reached[state]
                _offer(paths, best, target, cost + COST[INSERT], node, INSERT)
        new, old = best[target], reached[target]
        if new and (old is None or new[0] < old[0] or (
            # The strings differ before either ends, as both have an edit for each row so far.
            new[0] == old[0] and paths.less(new[1], new[2], old[1], "")
        )):
            reached[target] = (new[0], paths.add(new[1], new[2]))
    return reached


def step(paths: Paths, cells: Cells, initial: str, truncated: bool, deleted: bool) -> Cells:
    """The cells after one more row, with whatever is inserted before it."""
    before = cells if deleted else _inserted(paths, cells)
    best: list = [None] * 4
    for state, cell in enumerate(before):
        if cell is None:
            continue
        cost, node = cell
        _offer(paths, best, state, cost + COST[DELETE], node, DELETE)
        if deleted:
            continue
        target, letter = (ASSISTANT, "a") if state == USER else (USER, "u")
        more = TRUNCATED_COST if truncated else 0
        if initial == letter:
            _offer(paths, best, target, cost + more + COST[KEEP], node, KEEP)
        else:
            _offer(paths, best, target, cost + more + COST[REROLE], node, REROLE)
        if state == NOTHING and initial == "s":
            _offer(paths, best, SYSTEM, cost + more + COST[KEEP], node, KEEP)
    return _settle(paths, best)


def table(rows: list[tuple[str, bool, bool]], starts: Iterable[int]) -> tuple[list, list, list]:
    """Costs and ranks from every start state to every end state, and the strings by rank.

    No string ends in an insertion, so none of those of one segment begins another, and the ranks
    order whatever is made of them.
    """
    costs: list = [None] * 16
    strings: list = [None] * 16
    for start in starts:
        paths = Paths()
        cells: Cells = [None] * 4
        cells[start] = (0, 0)
        for row in rows:
            cells = step(paths, cells, *row)
        for end, cell in enumerate(cells):
            if cell:
                costs[4 * start + end] = cell[0]
                strings[4 * start + end] = "".join(paths.string(cell[1]))
    texts = sorted({s for s in strings if s is not None})
    place = {s: i for i, s in enumerate(texts)}
    return costs, [None if s is None else place[s] for s in strings], texts


def chain(tables: Iterable[tuple[list, list]]) -> tuple[int, list[int], int]:
    """Cost, the rank to take of each table, and how many rows to insert at the end."""
    paths = Paths()
    cells: Cells = [(0, 0), None, None, None]
    for costs, ranks in tables:
        best: list = [None] * 4
        for start, cell in enumerate(cells):
            if cell is None:
                continue
            for end in range(4):
                at = 4 * start + end
                if costs[at] is not None:
                    _offer(paths, best, end, cell[0] + costs[at], cell[1], ranks[at])
        cells = _settle(paths, best)
    # The end: nothing or an assistant's row, if need be an inserted one.
    last: list = [None]
    for state, more in ((NOTHING, 0), (ASSISTANT, 0), (USER, 1), (SYSTEM, 2)):
        if cells[state]:
            cost, node = cells[state]
            _offer(paths, last, 0, cost + more * COST[INSERT], node, more)
    cost, node, more = last[0]
    return cost, paths.string(node), more


SEGMENT_FIELDS = (
    "part int, seq int, low long, high long, turns long, last_turn long, first_turn long, "
    "blank long, duplicate long, truncated long, illegal long, first string, last string, "
    "costs array<long>, ranks array<int>, strings array<string>"
)


class _Segment:
    """A run of rows of one conversation, and what is known of it."""

    def __init__(self, number: int, begins: bool):
        self.number, self.begins = number, begins
        self.rows: list[tuple[str, bool, bool]] = []
        self.low = self.high = self.last_turn = self.first_turn = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.first = self.last = None

    def add(self, turn: int | None, initial: str, state: int, duplicate: bool) -> None:
        if turn is not None and (self.last_turn is None or turn != self.last_turn):
            if self.low is None:
                self.low = self.first_turn = turn
            self.high = self.last_turn = turn
            self.turns += 1
        if self.rows:
            self.illegal += self.last + initial not in LEGAL
        else:
            self.first = initial
        self.last = initial
        self.blank += state == BLANK
        self.duplicate += duplicate
        cut = state == TRUNCATED and not duplicate
        self.truncated += cut
        self.rows.append((initial, cut, duplicate or state == BLANK))

    def result(self, part: int, starts: Iterable[int]) -> tuple:
        return (
            part, self.number, self.low, self.high, self.turns, self.last_turn, self.first_turn,
            self.blank, self.duplicate, self.truncated, self.illegal, self.first, self.last,
            *table(self.rows, starts),
        )


def _segment_task(schema: pa.Schema, most: int):
    """For runs of equal rows in order: a row per segment. Columns as in ``_segments``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        conversation, segment, done = None, None, []

        def close() -> None:
            starts = (NOTHING,) if segment.begins else range(4)
            done.append((conversation, *segment.result(part, starts)))

        for batch in batches:
            for conv_id, turn, initial, state, n, duplicates in zip(
                *(column.to_pylist() for column in batch.columns)
            ):
                if segment is None:  # this conversation may have begun in the partition before
                    conversation, segment = conv_id, _Segment(0, begins=False)
                elif conv_id != conversation:
                    close()
                    conversation = conv_id
                    segment = _Segment(segment.number + 1, begins=True)
                for copy in range(n):
                    if len(segment.rows) == most:
                        close()
                        segment = _Segment(segment.number + 1, begins=False)
                    segment.add(turn, initial, state, copy >= n - duplicates)
            if done:
                yield pa.RecordBatch.from_pylist(
                    [dict(zip(schema.names, row)) for row in done], schema
                )
                done = []
        if segment is not None:
            close()
            yield pa.RecordBatch.from_pylist(
                [dict(zip(schema.names, row)) for row in done], schema
            )

    return run


def _chain_task(schema: pa.Schema):
    """For segments in order: the rank taken of each, and the whole's figures beside the last."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conversation, held, done = None, [], []

        def close() -> None:
            cost, ranks, more = chain((s["costs"], s["ranks"]) for s in held)
            low = [s["low"] for s in held if s["low"] is not None]
            high = [s["high"] for s in held if s["high"] is not None]
            turns = sum(s["turns"] for s in held)
            illegal = sum(s["illegal"] for s in held)
            for one, two in zip(held, held[1:]):
                illegal += one["last"] + two["first"] not in LEGAL
                if one["last_turn"] is not None and one["last_turn"] == two["first_turn"]:
                    turns -= 1
            gaps = min(max(high) - min(low) + 1 - turns, LONG) if low else 0
            totals = [sum(s[k] for s in held) for k in ("blank", "duplicate", "truncated")]
            for s, rank in zip(held, ranks):
                last = s is held[-1]
                done.append((
                    conversation, s["part"], s["seq"], rank, more if last else 0,
                    *([gaps, *totals, illegal, cost] if last else [None] * 6),
                ))

        for batch in batches:
            for row in batch.to_pylist():
                if held and row["conv_id"] != conversation:
                    close()
                    held = []
                conversation = row["conv_id"]
                held.append(row)
            if done:
                yield pa.RecordBatch.from_pylist(
                    [dict(zip(schema.names, row)) for row in done], schema
                )
                done = []
        if held:
            close()
            yield pa.RecordBatch.from_pylist(
                [dict(zip(schema.names, row)) for row in done], schema
            )

    return run


def _arrow_schema(df: DataFrame, fields: str) -> tuple[pa.Schema, T.StructType]:
    """The schema of ``conv_id`` and ``fields``, for Arrow and for Spark."""
    kind = df.schema["conv_id"].dataType
    struct = T._parse_datatype_string(f"conv_id {kind.simpleString()}, {fields}")
    return pa.schema([(f.name, to_arrow_type(f.dataType)) for f in struct.fields]), struct


def _digest(role: Column, text: Column) -> Column:
    """What stands for a row's role and text where only equality and a fixed order count."""
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))


def _turns(df: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    space = F.lit(" ")
    return df.select(
        F.col(conv_id).alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), space).alias("role"),
        F.coalesce(F.col(text).cast("string"), space).alias("text"),
    ).withColumn("digest", _digest(F.col("role"), F.col("text")))


ORDER = ("conv_id", "turn", "role", "digest")


def _segments(turns: DataFrame, most: int) -> DataFrame:
    end = F.rtrim("text", F.lit(WHITE))
    state = (
        F.when(end == "", BLANK)
        .when(F.substring(end, -1, 1).isin(".", "!", "?"), SOUND)
        .otherwise(TRUNCATED)
    )
    # No text is shuffled here. Equal rows of a turn are one row with their number, and
    # the first place of a text in its conversation is a minimum taken before the shuffle.
    runs = (
        turns.select(*ORDER, state.alias("state"))
        .groupBy(*ORDER, "state")
        .agg(F.count("*").alias("n"))
    )
    runs = materialize(runs, "turns")
    again = (
        runs.filter(F.col("state") != BLANK)
        .groupBy("conv_id", "digest")
        .agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("first"), F.count("*").alias("k"))
        .filter("k > 1")
        .select(F.col("conv_id").alias("c"), F.col("digest").alias("d"), F.col("first.turn").alias("f"))
    )
    here = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d"))
    is_first = F.col("d").isNull() | F.col("turn").eqNullSafe(F.col("f"))
    flagged = runs.join(again, here, "left").withColumn(
        "duplicates",
        F.when(F.col("state") == BLANK, 0).otherwise(F.col("n") - is_first.cast("long")),
    )
    # Ranges split a conversation of any length; a partition's number tells its place in it.
    ordered = flagged.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    schema, struct = _arrow_schema(turns, SEGMENT_FIELDS)
    return ordered.select(
        "conv_id", "turn", F.substring("role", 1, 1), "state", "n", "duplicates"
    ).mapInArrow(_segment_task(schema, most), struct)


FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def audits(
    df: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    segment: int = SEGMENT,
) -> DataFrame:
    """One row per conversation: its faults, and the cheapest edits that repair it.

    Rows are taken by turn, null turns first, rows of one turn by role, then in a fixed order of
    their texts; null roles and texts count as one space. A row's first fault counts: ``blank``
    without anything but white space, ``duplicate`` of an earlier row's role and text,
    ``truncated`` if it does not end in a full stop, exclamation or question mark. ``illegal``
    counts neighbours whose roles' initials are not su, ua or au, ``gaps`` the missing turns
    between the least and the greatest. ``audit`` has the initial of every edit in order: Keep,
    Rerole, Delete, or Insert. What the edits leave is nothing, or a system row, if kept, and
    rows of user and assistant in turn. Of equally cheap edits those whose initials come first
    are taken, and ``cost`` is theirs. Repeated rows are duplicates of one another. No rows give
    no rows; other columns are ignored whatever their names. Null ids are one conversation.

    A conversation is dealt out in segments of at most ``segment`` rows, wherever they lie. Each
    gets a table of costs from every state it may begin in to every state it may end in, and the
    tables are chained afterwards; so a task never holds a conversation of unbounded length.
    """
    found = materialize(_segments(_turns(df, conv_id, turn, role, text), segment), "segments")
    schema, struct = _arrow_schema(
        found, "part int, seq int, rank int, more int, " + ", ".join(f"{f} long" for f in FIGURES)
    )
    ordered = found.drop("strings").repartition("conv_id").sortWithinPartitions(
        "conv_id", "part", "seq"
    )
    chosen = ordered.mapInArrow(_chain_task(schema), struct).drop("conv_id")
    pieces = found.select("conv_id", "part", "seq", "strings").join(chosen, ["part", "seq"])
    piece = F.concat(F.get("strings", F.col("rank")), F.repeat(F.lit(INSERT), F.col("more")))
    return (
        pieces.groupBy("conv_id")
        .agg(
            *[F.max(f).alias(f) for f in FIGURES],
            F.collect_list(F.struct("part", "seq", piece.alias("piece"))).alias("pieces"),
        )
        .select(
            "conv_id",
            *FIGURES,
            F.array_join(F.transform(F.array_sort("pieces"), lambda p: p["piece"]), "").alias("audit"),
        )
    )


class Replay:
    """The rows that an audit makes of a conversation's rows, one after the other."""

    def __init__(self, audit: str):
        self.audit, self.at, self.made, self.system = audit, 0, 0, 0

    def _next(self) -> str:
        return ROLES[(self.made - self.system) % 2]

    def _insertions(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == INSERT:
            yield INSERT, self._next(), ""
            self.at, self.made = self.at + 1, self.made + 1

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """Edit, role and text of the rows up to and with what becomes of this one."""
        yield from self._insertions()
        edit = self.audit[self.at]
        self.at += 1
        if edit == DELETE:
            return
        if edit == KEEP and not self.made and role[:1] == "s":
            self.system = 1
        yield edit, role if edit == KEEP else self._next(), text
        self.made += 1

    def end(self) -> Iterator[tuple[str, str, str]]:
        yield from self._insertions()


def _replay_task(schema: pa.Schema, digest: bool):
    """For rows sorted by conversation, the audit's first: repaired rows, or their digest."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, replay, sha, done = None, None, None, []

        def put(rows: Iterable[tuple[str, str, str]]) -> None:
            for edit, role, text in rows:
                if digest:
                    sha.update(f"{chr(10) if replay.made else ''}{role}:{text}".encode())
                else:
                    done.append({
                        "conv_id": head["conv_id"], "place": replay.made, "edit": edit,
                        "role": role, "text": text,
                    })

        def close() -> None:
            put(replay.end())
            if digest:
                done.append(head | {"repaired_sha256": sha.hexdigest()})

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(
                [{k: row[k] for k in schema.names} for row in done], schema
            )

        for batch in batches:
            for row in batch.to_pylist():
                if row["audit"] is not None:
                    if head is not None:
                        close()
                    head, replay, sha = row, Replay(row["audit"]), hashlib.sha256()
                else:
                    put(replay.row(row["role"], row["text"]))
                if len(done) >= 1000:
                    yield flush()
                    done.clear()
        if head is not None:
            close()
        if done:
            yield flush()

    return run


def _replayed(df: DataFrame, found: DataFrame, names: tuple, digest: bool) -> DataFrame:
    rows = _turns(df, *names)
    figures = [c for c in found.columns if c not in ("conv_id", "audit")]
    none = F.lit(None)
    head = found.select(
        "conv_id", none.cast("long").alias("turn"), none.cast("string").alias("role"),
        none.cast("string").alias("text"), none.cast("binary").alias("digest"), "audit", *figures,
    )
    rows = rows.select(
        *rows.columns, none.cast("string").alias("audit"),
        *[none.cast(found.schema[c].dataType).alias(c) for c in figures],
    )
    both = head.unionAll(rows).withColumn("is_row", F.col("audit").isNull())
    both = both.repartition("conv_id").sortWithinPartitions("conv_id", "is_row", *ORDER[1:])
    if digest:
        kept = [f"{c} {found.schema[c].dataType.simpleString()}" for c in figures]
        fields = ", ".join([*kept, "audit string", "repaired_sha256 string"])
    else:
        fields = "place long, edit string, role string, text string"
    schema, struct = _arrow_schema(df.select(F.col(names[0]).alias("conv_id")), fields)
    return both.drop("is_row", "digest", "turn").mapInArrow(_replay_task(schema, digest), struct)


def repaired(
    df: DataFrame,
    found: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """The repaired rows: ``conv_id``, their ``place`` from 0, the ``edit`` they come from, role, text.

    ``found`` has a row with an ``audit`` for every conversation of ``df``, as :func:`audits` gives
    them. Rows stream through the tasks, none of which holds a conversation.
    """
    return _replayed(df, found, (conv_id, turn, role, text), digest=False)


def digests(
    df: DataFrame,
    found: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """``found`` with ``repaired_sha256``: of the repaired rows as role:text, joined by newlines.

    A hash reads its input in order, so the rows of one conversation stream through one task.
    """
    return _replayed(df, found, (conv_id, turn, role, text), digest=True)
