import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from helpers import CLASHING
from pyspark.sql import functions as F

from specaudit.llm import prefix_trie as P


def table(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.select("*", *(F.lit("x").alias(c) for c in (*CLASHING, "turns", "path", "sizes", "shard", "donor", "h", "digest")))


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    own = {c: [r[3:] for r in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    kids = defaultdict(set)
    for path in members:
        if path:
            kids[path[:-1]].add(path)

    def below(path):
        leaves, saved = int(not kids[path]), (len(members[path]) - 1) * len(path[-1][1].encode()) if path else 0
        for kid in kids[path]:
            more = below(kid)
            leaves, saved = leaves + more[0], saved + more[1]
        return leaves, saved

    out = []
    for path, convs in members.items():
        ends = ",".join(str(c) for c in convs if len(built[c]) == len(path))
        out.append((convs[0], len(path), members[path[:-1]][0] if path else None, len(convs), len(kids[path]), *below(path), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(seed, n=120, texts=3):
    """Paths that agree in many beginnings, with copies of whole conversations."""
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        conv = 5 * (c // 4) + rng.choice([0, 1, 2, 3]) if c % 3 else c
        if any(r[0] == conv for r in rows):
            continue
        for t in range(rng.choice([1, 2, 3, 9, 12])):
            rows.append((conv, rng.choice([None, t, t, t]), rng.choice(["user", "user", None, ""]), rng.choice(["", None, "é" * 5, "long " * 9][: texts + 1])))
    return [*rows, (None, 0, "user", "nobody's")]


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed,shards,ids", [(1, 1, 1000), (2, 3, 2), (3, 40, 1000), (4, 500, 3)])
def test_nodes_match_brute_force(spark, monkeypatch, seed, shards, ids):
    monkeypatch.setattr(P, "IDS", ids)
    rows = conversations(seed, texts=1 + seed % 3)
    got = P.prefix_trie(P.rebuilt(P.paths(table(spark, rows).repartition(3))), shards)
    assert found(got) == brute(rows)


def test_a_large_group_of_equal_conversations_is_cut(spark):
    rows = [(5 * c, t, "user", f"turn {t}") for c in range(300) for t in range(12)] + [(5 * c + 5, 20, "user", f"more {c}") for c in range(3)]
    paths = P.paths(table(spark, rows))
    path = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), ""))
    cuts = P.splitters(paths.select("conv_id", path.alias("path")), 8)
    assert len({p for p, _ in cuts}) < len(cuts)
    assert found(P.prefix_trie(P.rebuilt(paths), 8)) == brute(rows)


def test_long_paths_are_no_splitters(spark, monkeypatch):
    monkeypatch.setattr(P, "SPLITTER_TURNS", 3)
    rows = conversations(7)
    assert found(P.prefix_trie(P.rebuilt(P.paths(table(spark, rows))), 9)) == brute(rows)


def test_nothing_and_conversations_without_turns(spark):
    assert found(P.prefix_trie(P.rebuilt(P.paths(table(spark, []))))) == []
    short = [c for c in range(1, 400) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1][:30]  # no donor, one turn
    rows = [(c, 0, "user", "gone") for c in short]
    for shards in (1, 4):
        assert found(P.prefix_trie(P.rebuilt(P.paths(table(spark, rows))), shards)) == brute(rows)


def test_equals_sql(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    assert found(P.prefix_trie(P.rebuilt(P.paths(spark.read.parquet(f"{folder}/conversations.parquet"))), 7)) == sorted(con.execute(P.oracle_sql()).fetchall(), key=repr)
