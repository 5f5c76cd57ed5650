import random
import re

import numpy as np
import pytest
from helpers import documents, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from specaudit.llm import ngram_join as J


def brute_sets(rows, width=3):
    out = []
    for _, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        out.append(frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    return out


def brute(rows, percent=90, width=3):
    sets = brute_sets(rows, width)
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * len(a | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((doc, len(sets[i]), least.get(find(i))) for i, (doc, _) in enumerate(rows)), key=repr)


def near_copies(seed, bases=6, copies=12, words=60):
    """Groups of copies with a few words changed, around the threshold, and passages that many texts share."""
    rng = random.Random(seed)
    shared = prose(rng, 20)
    rows = []
    for _ in range(bases):
        base = (prose(rng, words) + " " + shared).split(" ")
        for _ in range(copies):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = prose(rng, 1)
            rows.append((len(rows), " ".join(copy)))
    return rows


EDGES = [(50, None), (51, ""), (52, " \n "), (53, "one"), (54, "ONE"), (55, "one two"), (56, "one two three"), (57, "one\ttwo\x0bthree"), (57, "one two three"), (None, "one two three"), (None, "alone here now"), (58, "é é"), (59, "É é"), (60, "w " * 30_000)]


@pytest.mark.parametrize("chunk,width,percent", [(256, 3, 90), (3, 3, 90), (256, 5, 80), (3, 5, 80)])
def test_groups_match_brute_force(spark, monkeypatch, chunk, width, percent):
    monkeypatch.setattr(J, "CHUNK_SETS", chunk)  # small chunks take the path of wide blocks
    limit = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if chunk == 3:
        spark.conf.set(limit, "5")  # runs of one key go over several batches
    rows = near_copies(chunk) + [(1000 + (d or 0) if d is not None else None, t) for d, t in EDGES]
    got = J.jaccard_components(documents(spark, rows), width, percent).collect()
    spark.conf.unset(limit)
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, percent, width)


def test_empty_table(spark):
    assert J.jaccard_components(documents(spark, [])).collect() == []
    assert J.one_of_each_group(documents(spark, [])).collect() == []


def test_one_of_each_group_keeps_columns_and_smallest_ids(spark):
    rows = [(5, "a b c d"), (3, "A b c d"), (3, "a b c d"), (3, "a b c d"), (9, None), (8, ""), (None, "a b c d"), (None, "only one here")]
    docs = documents(spark, rows)
    kept = J.one_of_each_group(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(
        [(3, "A b c d"), (3, "a b c d"), (9, None), (8, ""), (None, "only one here")], key=repr)


@given(st.lists(st.sets(st.integers(0, 40), min_size=1, max_size=30), min_size=1, max_size=12), st.integers(50, 95))
@settings(max_examples=150, deadline=None)
def test_divide_skip_finds_exactly_the_linked_sets(sets, percent):
    sets = sorted(sets, key=len)
    index = J.Index([np.array(sorted(s), np.uint64) for s in sets], percent)
    for q in sets:
        want = {i for i, s in enumerate(sets) if 100 * len(q & s) >= percent * len(q | s)}
        assert set(index.search(np.array(sorted(q), np.uint64), lambda i: False)) == want


@given(st.integers(1, 400), st.integers(0, 60), st.integers(0, 60), st.sampled_from([80, 90]), st.randoms(use_true_random=False))
@settings(max_examples=400, deadline=None)
def test_linked_sets_share_the_least_number_of_keys(n, less, more, percent, rng):
    values = [rng.getrandbits(64) for _ in range(n + more)]
    a = set(values[:n])
    b = set(values[min(less, n - 1) :])
    if a != b and 100 * len(a & b) >= percent * len(a | b):
        one, other = (J.range_keys(np.array(sorted(s), np.uint64), percent) for s in (a, b))
        shared = [(len(set(x.tolist()) & set(y.tolist())), lx, ly) for x, lx in one for y, ly in other]
        assert any(both >= max(lx, ly) > 0 for both, lx, ly in shared)
