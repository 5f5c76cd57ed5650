import functools
import hashlib
import itertools
import random
import re
import sys
import zlib
from collections import defaultdict

import pytest
from helpers import CLASHING
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from specaudit.llm import conversation_repair as R


def table(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.select("*", *(F.lit("x").alias(c) for c in (*CLASHING, "gone", "again", "first", "digest", "kind", "copies")))


sys.setrecursionlimit(20_000)  # for from_the_end
SPACE = " \t\n\x0b\x0c\r"


def brute_edits(rows):
    """The least (cost, audit, repaired) over every sequence of edits, growing the cost; rows: (role, text, fault)."""
    best = None

    def go(i, out, cost, audit, inserted):
        nonlocal best
        if best and cost > best[0]:
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in out)):
            if best is None or (cost, audit) < best[:2]:
                best = cost, audit, [f"{r}:{t}" for r, t in out]
        if inserted < 2:  # more in a row than two can be left out again
            for role in ("user", "assistant"):
                go(i, [*out, (role, "")], cost + 2, audit + "I", inserted + 1)
        if i < len(rows):
            role, text, fault = rows[i]
            go(i + 1, out, cost + 3, audit + "D", 0)
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                go(i + 1, [*out, (role, text)], cost + extra, audit + "K", 0)
                for new in ("user", "assistant"):
                    go(i + 1, [*out, (new, text)], cost + 2 + extra, audit + "R", 0)

    best = (3 * len(rows), "D" * len(rows), [])
    go(0, [], 0, "", 0)
    return best


def from_the_end(rows):
    """The same from the last row back: what remains to be edited from each beginning `done` (its last initial)."""

    @functools.cache
    def rest(i, done, inserted):
        found = [(0, "", ())] if i == len(rows) and done in ("", "a") else []

        def take(role, text, cost, edit, j, more):
            if role and done + role[:1] in ("s", "u", "su", "ua", "au"):
                c, audit, lines = rest(j, role[:1], more)
                found.append((c + cost, edit + audit, (f"{role}:{text}", *lines)))

        if inserted < 2:
            take("user", "", 2, "I", i, inserted + 1)
            take("assistant", "", 2, "I", i, inserted + 1)
        if i < len(rows):
            role, text, fault = rows[i]
            c, audit, lines = rest(i + 1, done, 0)
            found.append((c + 3, "D" + audit, lines))
            if fault not in ("blank", "duplicate"):
                take(role, text, fault == "truncated", "K", i + 1, 0)
                take("user", text, 2 + (fault == "truncated"), "R", i + 1, 0)
                take("assistant", text, 2 + (fault == "truncated"), "R", i + 1, 0)
        return min(found, default=(10**9, "", ()))

    return rest(0, "", 0)


def brute(rows):
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        row = (turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
        groups[conv] += [row] * {0: 0, 3: 2}.get(kind, 1)
    out = []
    for conv, turns in groups.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, judged, counts = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in turns:
            words = text.strip(SPACE)
            fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else None
            seen.add((role, text))
            judged.append((role, text, fault))
            if fault:
                counts[fault] += 1
        known = [t for t, _, _ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        cost, audit, repaired = from_the_end(judged)
        out.append((conv, gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(seed, n, most, turn=lambda rng, t: t):
    rng = random.Random(seed)
    texts = ["One. ", "Two!", "Three", "", " \n", None, "é?", "Four. five"]
    rows = []
    for c in range(n):
        conv = rng.choice([None, c]) if c < 2 else c
        for t in range(rng.randint(1, most)):
            rows.append((conv, turn(rng, t), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), rng.choice(texts)))
    return rows


def spark_rows(got):
    return sorted((tuple(r)[:9] for r in got.collect()), key=repr)


@pytest.mark.parametrize("chunk", [128, 1, 3])
def test_repairs_match_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(R, "CHUNK", chunk)
    rows = conversations(chunk, 60, 6) + conversations(chunk + 9, 30, 5, lambda rng, t: rng.choice([None, 0, 1, 7]))
    rows = [(c if c is None or i < 200 else c + 1000, *r) for i, (c, *r) in enumerate(rows)]
    assert spark_rows(R.repaired(R.damaged(table(spark, rows)))) == brute(rows)


ROW = st.tuples(st.sampled_from("suat"), st.booleans(), st.booleans())


@given(st.lists(ROW, max_size=40), st.integers(1, 7))
@settings(max_examples=150, deadline=None)
def test_chunks_do_not_change_the_result(rows, chunk):
    def result(size):
        R.CHUNK, before = size, R.CHUNK
        try:
            c = R.Conversation()
            for i, (role, blank, whole) in enumerate(rows):
                c.add(i, role, "" if blank else f"{i}." if whole else f"{i}", False)
            return c.result()
        finally:
            R.CHUNK = before

    assert result(chunk) == result(1000)


@given(st.lists(ROW, max_size=3))
@settings(max_examples=100, deadline=None)
def test_the_agenda_finds_the_least_value(rows):
    rows = [(role, "x", "blank" if gone else "truncated" if broken else None) for role, gone, broken in rows]
    cost, audit, lines = brute_edits(rows)
    assert (cost, audit, tuple(lines)) == from_the_end(rows)
    (found,) = R.lightest([R.Row(r, t, f == "blank", f == "truncated") for r, t, f in rows], {R.START: (0, "")}, R.GOALS).values()
    assert found[:2] == (cost, audit)


def test_one_long_conversation_with_repeats(spark):
    rows = [(5, t, ("user", "assistant")[t % 2], f"Turn {t % 150}.") for t in range(400)]
    assert spark_rows(R.repaired(R.damaged(table(spark, rows)))) == brute(rows)


def test_turns_of_the_repair_hash_to_its_digest(spark):
    rows = R.damaged(table(spark, conversations(4, 40, 9)))
    repairs = R.repaired(rows)
    turns = defaultdict(list)
    for r in R.repaired_turns(rows, repairs).collect():
        turns[r.conv_id].append((r.place, f"{r.role}:{r.text}"))
    for r in repairs.collect():
        text = "\n".join(line for _, line in sorted(turns[r.conv_id]))
        assert hashlib.sha256(text.encode()).hexdigest() == r.repaired_sha256


def test_nothing_and_all_rows_dropped(spark):
    assert R.repaired(R.damaged(table(spark, []))).collect() == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert spark_rows(R.repaired(R.damaged(table(spark, [(gone, 0, "user", "Hello.")])))) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
