import random

import pytest
from test_graph import edges_df, reach

from specaudit.operators import contraction as K
from specaudit.operators import graph as G


def waves(edges, nodes):
    into = {n: [s for s, d in edges if d == n] for n in nodes}
    out, open_ = {}, set(nodes)
    while ready := [n for n in open_ if all(s in out for s in into[n])]:
        for n in ready:
            out[n] = max((out[s] + 1 for s in into[n]), default=0)
        open_ -= set(ready)
    return out | dict.fromkeys(open_)


def strong(edges):
    r = reach(edges)
    nodes = {n for e in edges for n in e}
    groups = {a: {b for b in nodes if (a, b) in r and (b, a) in r} | {a} for a in nodes}
    return {a: (min(g), len(g)) for a, g in groups.items() if len(g) > 1 or (a, a) in edges}


def check(spark, edges, nodes=()):
    nodes = {n for e in edges for n in e} | set(nodes)
    df = edges_df(spark, edges)
    assert {x.node: (x.component, x.size) for x in G.cycle_components(df).collect()} == strong(edges)
    got = G.topo_wave(df, spark.createDataFrame([(n,) for n in nodes], "node long")).collect()
    assert len(got) == len(nodes) and {x.node: x.wave for x in got} == waves(edges, nodes)


CASES = {
    "ring": [(i, (i + 1) % 9) for i in range(9)],
    "two rings by a chain, with a tail": [(i, (i + 1) % 5) for i in range(5)] + [(4, 10), (10, 11), (11, 12), (12, 20)] + [(20 + i, 20 + (i + 1) % 4) for i in range(4)] + [(22, 30), (30, 31)],
    "pair, loop, and a bridge over a loop": [(1, 2), (2, 1), (3, 3), (4, 5), (5, 4), (5, 6), (6, 7), (3, 8), (8, 9)],
    "ladder": [(i, i + 2) for i in range(20)] + [(i, i + 1) for i in range(0, 20, 2)],
    "tree": [(i // 2, i) for i in range(2, 40)],
    "paths of several lengths": [(0, 1), (1, 2), (2, 3), (3, 9), (0, 9), (0, 4), (4, 9), (9, 10), (7, 2)],
    "nothing": [],
}


@pytest.mark.parametrize("case", CASES)
def test_shapes(spark, case):
    check(spark, sorted(set(CASES[case])), [100])


@pytest.mark.parametrize("seed", range(4))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    n, m = rng.choice([(30, 36), (25, 60), (60, 70), (40, 44)])
    check(spark, sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(m)}))


def test_long_paths_need_few_rounds(spark, monkeypatch):
    rng = random.Random(9)
    names = rng.sample(range(10**9), 4000)
    chain = [(names[i], names[i + 1]) for i in range(3999)]
    core, rounds = K.contracted(edges_df(spark, chain))
    assert core.isEmpty() and len(rounds) < 25
    core, rounds = K.contracted(edges_df(spark, [*chain, (names[-1], names[0])]))
    assert core.isEmpty() and len(rounds) < 25
    members = K.bridged(spark.createDataFrame([], "node long, component long"), rounds)
    assert members.count() == 4000 and members.select("component").distinct().count() == 1
