import random

from specaudit.operators import graph as G


def edges_df(spark, edges):
    return spark.createDataFrame(edges, "src long, dst long")


def reach(edges):
    nodes = {n for e in edges for n in e}
    out = {n: {d for s, d in edges if s == n} for n in nodes}
    found = {}
    for root in nodes:
        depth, frontier, seen = 0, {root}, {root}
        while frontier:
            depth += 1
            frontier = {d for n in frontier for d in out[n]} - seen
            seen |= frontier
            for n in frontier:
                found[root, n] = depth
    return found


def random_edges(seed, n=14, m=22):
    rnd = random.Random(seed)
    return sorted({(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)})


def test_closure_matches_search(spark):
    edges = random_edges(1)
    got = {(r.root, r.node): r.depth for r in G.downstream_closure(edges_df(spark, edges)).collect()}
    assert got == reach(edges)
    two = {(r.root, r.node): r.depth for r in G.downstream_closure(edges_df(spark, edges), max_depth=2).collect()}
    assert two == {k: d for k, d in reach(edges).items() if d <= 2}


def test_cycles_match_mutual_reachability(spark):
    for seed in (2, 3):
        edges = random_edges(seed)
        r = reach(edges)
        want = {}
        for a in {n for e in edges for n in e}:
            group = {b for b in {n for e in edges for n in e} if (a, b) in r and (b, a) in r} | {a}
            if len(group) > 1 or (a, a) in edges:
                want[a] = (min(group), len(group))
        got = {x.node: (x.component, x.size) for x in G.cycle_components(edges_df(spark, edges)).collect()}
        assert got == want


def test_components_match_union(spark):
    edges = random_edges(4, n=30, m=18)
    label = {n: n for e in edges for n in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.component for r in G.components(edges_df(spark, edges)).collect()}
    assert got == label


def test_waves_leave_cycles_unranked(spark):
    edges = [(1, 2), (2, 3), (1, 3), (4, 5), (5, 4), (5, 6)]
    nodes = spark.createDataFrame([(n,) for n in range(1, 8)], "node long")
    got = {r.node: r.wave for r in G.topo_wave(edges_df(spark, edges), nodes).collect()}
    assert got == {1: 0, 2: 1, 3: 2, 4: None, 5: None, 6: None, 7: 0}


def brute_order(edges, rank):
    left, order = set(rank), []
    while True:
        ready = [n for n in left if not any(d == n and s in left for s, d in edges)]
        if not ready:
            return order + sorted(left, key=rank.get)
        node = min(ready, key=rank.get)
        order.append(node)
        left.remove(node)


def test_rerun_order_both_ways(spark):
    edges = [(5, 1), (5, 2), (1, 4), (2, 3), (6, 7), (7, 6), (3, 8)]
    rank = {n: (n % 2, n, n) for n in range(1, 9)}
    rows = [(root, n, rank[n][0], rank[n][1]) for root in (1, 2) for n in rank]
    affected = spark.createDataFrame(rows, "root long, node long, table_position int, position int")
    want = brute_order(edges, rank)
    for limit in (100, 3):
        got = {}
        for r in G.rerun_order(edges_df(spark, edges), affected, limit).orderBy("seq").collect():
            got.setdefault(r.root, []).append(r.node)
        assert got == {1: want, 2: want}


def test_many_small_roots_are_ordered_a_batch_per_call(spark):
    """Roots with an order of their own each, told apart inside one batch, which is what tasks are called with."""
    edges = [(a, b) for a in range(1, 9) for b in (a * 2, a * 2 + 1) if b < 9] + [(8, 1)]
    rank = {n: (n % 3, -n, n) for n in range(1, 9)}
    sets = {root: {n for n in rank if (root >> (n % 5)) & 1} for root in range(1, 200)}
    rows = [(root, n, rank[n][0], rank[n][1]) for root, part in sets.items() for n in part]
    affected = spark.createDataFrame(rows, "root long, node long, table_position int, position int")
    ordered = G.rerun_order(edges_df(spark, edges), affected)
    assert "FlatMapCoGroupsInPandas [batch" in ordered._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in sorted(ordered.collect()):
        got.setdefault(r.root, []).append((r.seq, r.node))
    for root, part in sets.items():
        inner = [(a, b) for a, b in edges if a in part and b in part]
        assert [n for _, n in sorted(got.get(root, []))] == brute_order(inner, {n: rank[n] for n in part})


def test_closure_from_shared_root_label(spark):
    roots = spark.createDataFrame([(9, 1), (9, 2)], "root long, node long")
    got = {(r.node, r.depth) for r in G.downstream_closure(edges_df(spark, [(1, 2), (2, 3), (3, 4)]), roots).collect()}
    assert got == {(3, 1), (4, 2)}


def test_stale_columns_are_put_in_order_per_matter(spark):
    from specaudit.operators.staleness import stale_rerun_order

    rng = random.Random(6)
    edges = sorted({(a, b) for a, b in ((rng.randrange(40), rng.randrange(40)) for _ in range(60)) if a % 2 == b % 2 and a != b})
    states = [(n, n % 4, rng.choice(["direct", "transitive", "current", "never_run"])) for n in range(40)]
    rank = {n: (n % 4, -n, n) for n in range(40)}
    got = stale_rerun_order(
        spark.createDataFrame(states, "column_id long, table_id long, state string"), edges_df(spark, edges),
        spark.createDataFrame([(t, t % 2) for t in range(4)], "table_id long, matter_id long"),
        spark.createDataFrame([(n, n % 4, -n) for n in range(40)], "column_id long, table_position int, position int")).orderBy("seq").collect()
    for matter in (0, 1):
        stale = {n for n, t, state in states if t % 2 == matter and state in ("direct", "transitive")}
        inner = [(a, b) for a, b in edges if a in stale and b in stale]
        assert [r.column_id for r in got if r.matter_id == matter] == brute_order(inner, {n: rank[n] for n in stale})
