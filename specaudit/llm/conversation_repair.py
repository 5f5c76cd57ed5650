"""Structure repair of conversations by Knuth's lightest-derivation agenda.

A conversation should read `(s?(ua)+)?` in the initials of its roles. The edits are Keep (0), Rerole to user or assistant
(2), Delete (3, required for blank and repeated rows) and Insert an empty user or assistant row (2); a row whose text
breaks off and that is not deleted adds 1. A repair is a derivation in a weighted hypergraph: the item (i, state) says
that the first i rows have been turned into a well-formed beginning that ends in that state; every edit deduces an item
from another one and, as a side condition, the next row. The value of an item is (cost, audit), the audit being the
initials of its edits. Each deduction adds to the cost or leaves it, and appends a letter, so it is superior: nothing
deduced lies below what it was deduced from. It is monotone too: derivations of one item use the same number of rows, so at
equal cost neither audit is a beginning of the other (it would lack an Insert, which costs), and appending keeps their
order. An agenda in the order of values therefore finalises each item once, at its least value, and ends with the goal.

The audit determines the repair: from each state only one role can be inserted or reroled to.

Scale: rows are dealt by conversation and sorted, and a task streams them. The agenda works on `CHUNK` rows at a time: the
final items at the end of one chunk (four at most, each with its running hash) are the axioms of the next, so memory is
bounded by a chunk and by the audit itself, which the result holds anyway, however long a conversation is. Its hash reads
the repaired texts in order, so one conversation is streamed by one task. Which texts are repeated is found before, by an
aggregate over digests of rows, so that no task remembers what it has seen.

Edge cases: a null role or text is one space. A role that is empty has no initial and cannot be kept. Rows come in the order of turn (nulls first), role and text. A null conv_id
is a conversation of its own. Rows marked as gone count for nothing but the existence of their conversation: with no other
rows, all numbers are 0, the audit is empty and the hash is that of the empty string. No rows give no rows. Other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import os
from collections.abc import Iterable, Iterator
from itertools import groupby, islice
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 128  # rows that one agenda works on
ROWS_OUT = 1000
REROLE, DELETE, INSERT, BROKEN = 2, 3, 2, 1

START, SYSTEM, USER, ASSISTANT = range(4)
_AFTER = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
_NEXT = {START: ("user", USER), SYSTEM: ("user", USER), ASSISTANT: ("user", USER), USER: ("assistant", ASSISTANT)}
GOALS = (START, ASSISTANT)
_ALL = tuple(range(4))
_SPACE = " \t\n\x0b\x0c\r"
_LEGAL = {"su", "ua", "au"}


class Row:
    __slots__ = ("role", "text", "initial", "must_go", "broken")

    def __init__(self, role: str, text: str, must_go: bool, broken: bool):
        self.role, self.text, self.initial, self.must_go, self.broken = role, text, role[:1], must_go, broken


def deductions(rows: list[Row], i: int, state: int) -> Iterator[tuple[int, int, int, str]]:
    """(i, state, cost, edit) of all that follows from an item."""
    after = _NEXT[state][1]
    yield i, after, INSERT, "I"
    if i < len(rows):
        row = rows[i]
        yield i + 1, state, DELETE, "D"
        if not row.must_go:
            if (state, row.initial) in _AFTER:
                yield i + 1, _AFTER[state, row.initial], BROKEN * row.broken, "K"
            yield i + 1, after, REROLE + BROKEN * row.broken, "R"


def lightest(rows: list[Row], axioms: dict[int, tuple[int, str]], goals: tuple[int, ...] | None) -> dict[int, tuple[int, str, int]]:
    """Values of states after all rows, as (cost, audit, axiom); of the least goal alone if there are `goals`."""
    agenda = [(cost, audit, 0, state, state) for state, (cost, audit) in axioms.items()]
    heapq.heapify(agenda)
    final, out = set(), {}
    while agenda:
        cost, audit, i, state, origin = heapq.heappop(agenda)
        if (i, state) in final:
            continue
        final.add((i, state))
        if i == len(rows):
            if goals and state in goals:
                return {state: (cost, audit, origin)}
            out[state] = cost, audit, origin
            if not goals and len(out) == len(_ALL):
                break
        for j, after, more, edit in deductions(rows, i, state):
            if (j, after) not in final:
                heapq.heappush(agenda, (cost + more, audit + edit, j, after, origin))
    return out


def applied(rows: Iterable[Row], state: int, audit: str) -> Iterator[tuple[int, str, str]]:
    """(state before, role, text) of the rows that an audit gives."""
    rows = iter(rows)
    for edit in audit:
        row = None if edit == "I" else next(rows)
        if edit == "D":
            continue
        role, after = (row.role, _AFTER[state, row.initial]) if edit == "K" else _NEXT[state]
        yield state, role, row.text if row else ""
        state = after


class Conversation:
    """What one conversation has come to so far."""

    def __init__(self) -> None:
        self.low = self.high = self.turn = self.before = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.rows: list[Row] = []
        self.settled: list[str] = []  # what the audits of all items begin with
        self.items = {START: (0, "", hashlib.sha256())}

    def add(self, turn: int | None, role: str, text: str, repeated: bool) -> None:
        if turn is not None and turn != self.turn:
            self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = self.turn = turn
        words = text.rstrip(_SPACE)
        blank = not words
        broken = not blank and not repeated and words[-1] not in ".!?"
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + (repeated and not blank), self.truncated + broken
        self.illegal += self.before is not None and self.before + role[:1] not in _LEGAL
        self.before = role[:1]
        self.rows.append(Row(role, text, blank or repeated, broken))
        if len(self.rows) == CHUNK:
            self._advance(None)

    def _advance(self, goals: tuple[int, ...] | None) -> None:
        found, items = lightest(self.rows, {q: (c, a) for q, (c, a, _) in self.items.items()}, goals), {}
        for state, (cost, audit, origin) in found.items():
            _, known, hashed = self.items[origin]
            hashed = hashed.copy()
            for before, role, text in applied(self.rows, origin, audit[len(known) :]):
                hashed.update((f"\n{role}:{text}" if before != START else f"{role}:{text}").encode())
            items[state] = cost, audit, hashed
        same = len(os.path.commonprefix([audit for _, audit, _ in items.values()]))
        self.settled.append(next(iter(items.values()))[1][:same])
        self.items = {state: (cost, audit[same:], hashed) for state, (cost, audit, hashed) in items.items()}
        self.rows = []

    def result(self) -> tuple:
        self._advance(GOALS)
        ((cost, rest, hashed),) = self.items.values()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, "".join(self.settled) + rest, hashed.hexdigest()


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): rows damaged by a checksum of their name; see the query's contract."""
    conv, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    name = F.concat(F.coalesce(conv.cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(turn.cast("string"), F.lit(" ")))
    kind = F.crc32(F.encode(name, "UTF-8")) % 20
    role, text = F.coalesce(F.col("role").cast("string"), F.lit(" ")), F.coalesce(F.col("text").cast("string"), F.lit(" "))
    rows = conversations.select(conv.alias("conv_id"), turn.alias("turn"), role.alias("role"), text.alias("text"), kind.alias("kind")).select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("kind") == 0).alias("gone"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies", "copy")


def _with_first_turns(rows: DataFrame) -> DataFrame:
    """With `again` and `first`: whether role and text occur more than once in the conversation, and the first turn they have."""
    rows = rows.withColumn("digest", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    turn = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    seen = rows.where("not gone").groupBy(F.col("conv_id").alias("of"), F.col("digest").alias("same")).agg(F.count("*").alias("n"), F.min(turn).alias("first"))
    again = seen.where("n > 1").select("of", "same", F.col("first.turn").alias("first"), F.lit(True).alias("again"))
    return rows.join(again, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("same")), "left").select(
        "conv_id", "turn", "role", "text", "gone", F.coalesce("again", F.lit(False)).alias("again"), "first")


def _streamed(rows: DataFrame) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")


def _lines(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _batches(rows: Iterable[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    kinds = {"long": pa.int64(), "string": pa.string()}
    names, types = zip(*(field.split(" ") for field in schema.split(", ")))
    rows = iter(rows)
    while out := list(islice(rows, ROWS_OUT)):
        yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, k in zip(zip(*out), types)], list(names))


class _Repeats:
    """Tells of the rows of a sorted conversation which have been seen earlier in it."""

    def __init__(self) -> None:
        self.last = None

    def __call__(self, turn, role, text, again: bool, first) -> bool:
        if not again:
            return False
        same, self.last = self.last == (turn, role, text), (turn, role, text)
        return same or turn != first


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repaired(rows: DataFrame) -> DataFrame:
    """One row per conversation of (conv_id, turn, role, text, gone): its faults, the cheapest repair and a hash of it."""

    def results(lines: Iterable[tuple]) -> Iterator[tuple]:
        for conv, turns in groupby(lines, key=itemgetter(0)):
            conversation, repeats = Conversation(), _Repeats()
            for _, turn, role, text, gone, again, first in turns:
                if not gone:
                    conversation.add(turn, role, text, repeats(turn, role, text, again, first))
            yield conv, *conversation.result()

    return _streamed(_with_first_turns(rows)).mapInArrow(lambda batches: _batches(results(_lines(batches)), RESULT), RESULT)


TURNS = "conv_id long, place long, role string, text string"


def repaired_turns(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the repaired conversations, from the rows and the audits that `repaired` gives for them."""
    # An audit comes before the rows of its conversation, so a task holds one audit and no texts.
    audits = repairs.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"))
    both = audits.unionByName(rows.where("not gone").select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text"))
    both = both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", F.col("turn").asc_nulls_first(), "role", "text")

    def turns(lines: Iterable[tuple]) -> Iterator[tuple]:
        for conv, group in groupby(lines, key=itemgetter(0)):
            audit = next(group)[4]
            left = (Row(role, text, False, False) for _, _, _, role, text in group)
            for place, (_, role, text) in enumerate(applied(left, START, audit)):
                yield conv, place, role, text

    return both.mapInArrow(lambda batches: _batches(turns(_lines(batches)), TURNS), TURNS)
