"""Dependency graphs over columns: reachability, cycles, waves, components, rerun order.

All of them run for every matter and every root at once. Control flow is a driver loop that only
looks at row counts; each round's table is written to the shared folder, so lineage stays short
and a lost executor costs one round at most.
"""

from __future__ import annotations

import heapq
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specaudit.operators.contraction import bridged, contracted, longest_paths, sized
from specaudit.session import cut


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _pairs(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").distinct()


def downstream_closure(edges: DataFrame, roots: DataFrame | None = None, max_depth: int | None = None) -> DataFrame:
    """(root, node, depth, direct): what each root reaches, at its smallest distance.

    Without `roots` every node is one. Known distances up to d are composed with those of exactly d,
    which gives all shortest paths up to 2d, so the number of rounds grows with the logarithm of the
    longest distance and each new pair is made once per middle node.
    """
    steps = _pairs(edges).where("src <> dst")
    if roots is not None:
        return _from_roots(steps, roots, max_depth)
    known = [cut(steps.select(F.col("src").alias("root"), F.col("dst").alias("node"), F.lit(1).alias("depth")))]
    reach = 1
    while max_depth is None or reach < max_depth:
        paths = _union(known)
        tips = paths.where(F.col("depth") == reach).select("root", F.col("node").alias("mid"))
        tails = paths.select(F.col("root").alias("mid"), "node", F.col("depth").alias("more"))
        longer = tips.join(tails, "mid").where("root <> node")
        if max_depth is not None:
            longer = longer.where(F.col("more") + reach <= max_depth)
        found = longer.groupBy("root", "node").agg((F.min("more") + reach).cast("int").alias("depth"))
        fresh = cut(found.join(paths, ["root", "node"], "left_anti"))
        if fresh.isEmpty():
            break
        known.append(fresh)
        reach *= 2
    return _union(known).withColumn("direct", F.col("depth") == 1)


def _from_roots(steps: DataFrame, roots: DataFrame, max_depth: int | None) -> DataFrame:
    """Frontier search for (root, node) seeds, where several nodes may share one root label."""
    seeds = roots.select("root", "node").distinct()
    seen = [cut(seeds.withColumn("depth", F.lit(0)))]
    depth = 0
    while max_depth is None or depth < max_depth:
        edge = seen[-1].join(steps, F.col("node") == F.col("src"))
        hit = edge.select("root", F.col("dst").alias("node")).distinct()
        depth += 1
        fresh = cut(hit.join(_union(seen), ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if fresh.isEmpty():
            break
        seen.append(fresh)
    return _union(seen).where("depth > 0").withColumn("direct", F.col("depth") == 1)


def upstream_closure(edges: DataFrame, roots: DataFrame | None = None, max_depth: int | None = None) -> DataFrame:
    flipped = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return downstream_closure(flipped, roots, max_depth)


def impact_via(closure: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges that carry a change to each affected node: from its root or from another hit node."""
    hit = closure.select("root", "node")
    own = closure.select("root").distinct().withColumn("node", F.col("root"))
    carriers = hit.unionByName(own).withColumnRenamed("node", "src")
    steps = edges.select("src", F.col("dst").alias("node"), "kind").distinct()
    return carriers.join(steps, "src").join(hit, ["root", "node"], "left_semi").select("root", "node", F.col("src").alias("via"), "kind")


def tables_affected(closure: DataFrame, vertices: DataFrame) -> DataFrame:
    place = vertices.select(F.col("column_id").alias("node"), "table_id")
    return closure.join(place, "node").groupBy("root", "table_id").agg(F.count("*").alias("n"))


def impact_detail(closure: DataFrame, via: DataFrame, cycles: DataFrame) -> DataFrame:
    """(root, node, depth, direct, in_cycle, n_via): each affected node, whether it is on a cycle, and how many edges carry the change to it."""
    carried = via.groupBy("root", "node").agg(F.count("*").alias("n_via"))
    looped = cycles.select("node", F.lit(True).alias("looped")).distinct()
    row = closure.join(carried, ["root", "node"], "left").join(looped, "node", "left")
    return row.select("root", "node", "depth", "direct", F.coalesce("looped", F.lit(False)).alias("in_cycle"), F.coalesce("n_via", F.lit(0)).alias("n_via"))


def impact_totals(closure: DataFrame, vertices: DataFrame) -> DataFrame:
    per = tables_affected(closure, vertices).groupBy("root").agg(F.count("*").alias("tables"))
    sums = closure.groupBy("root").agg(
        F.count("*").alias("affected"), F.count_if("direct").alias("direct"),
        F.count_if(~F.col("direct")).alias("transitive"), F.max("depth").alias("longest"),
    )
    return sums.join(per, "root")


_STEPS = 3  # propagation steps per written round


def _coloured(steps: DataFrame) -> list[DataFrame]:
    """(node, component) parts of the strongly connected components of a graph that cannot be contracted.

    Each node takes the smallest label that reaches it, and what reaches back to the owner of that label is one component.
    Memory stays linear in the edges: no list of mutually reachable pairs is ever made.
    """
    found: list[DataFrame] = []
    while not steps.isEmpty():
        colour = cut(
            steps.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("label", F.col("node"))
        )
        rows = colour.count()
        while True:
            ahead = colour.withColumnRenamed("label", "start").withColumn("label", F.col("start"))
            for _ in range(_STEPS):
                sent = steps.join(ahead.select(F.col("node").alias("src"), "label"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("got"))
                ahead = ahead.join(sent, "node", "left").select("node", "start", F.least("label", "got").alias("label"))
            ahead = cut(sized(ahead, rows))
            colour = ahead.select("node", "label")
            if ahead.where("label < start").isEmpty():
                break
        src = colour.select(F.col("node").alias("src"), F.col("label").alias("l1"))
        dst = colour.select(F.col("node").alias("dst"), F.col("label").alias("l2"))
        inner = cut(steps.join(src, "src").join(dst, "dst").where("l1 = l2").select("src", "dst"))
        # What reaches the owner of its own label.
        state = colour.withColumn("got", F.col("node") == F.col("label"))
        while True:
            ahead = state.withColumn("start", F.col("got"))
            for _ in range(_STEPS):
                hit = inner.join(ahead.where("got").select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node")).distinct()
                ahead = ahead.join(hit.withColumn("hit", F.lit(True)), "node", "left").select("node", "label", "start", (F.col("got") | F.col("hit").isNotNull()).alias("got"))
            ahead = cut(sized(ahead, rows))
            state = ahead.select("node", "label", "got")
            if ahead.where("got and not start").isEmpty():
                break
        group = state.where("got").select("node", F.col("label").alias("component"))
        done = group.select("node")
        rest, rounds = contracted(
            steps.join(done.withColumnRenamed("node", "src"), "src", "left_anti")
            .join(done.withColumnRenamed("node", "dst"), "dst", "left_anti")
        )
        found.append((group, rounds))
        steps = rest
    return found


def cycle_components(edges: DataFrame) -> DataFrame:
    """(node, component, size) of every node on a cycle; the component is its smallest node.

    Ends and chains are taken off first, in a number of rounds that grows with the logarithm of their length. What is left is
    coloured, and what was taken off after each colouring is put back from the last round to the first.
    """
    every = cut(_pairs(edges))
    core, rounds = contracted(every.where("src <> dst"))
    members = every.select(F.col("src").alias("node"), F.col("src").alias("component")).where("false")
    for group, more in reversed(_coloured(core)):
        members = bridged(members, more).unionByName(group)
    joined = cut(bridged(members, rounds))
    named = joined.groupBy("component").agg(F.min("node").alias("least"), F.count("*").alias("size")).where("size > 1")
    real = joined.join(named, "component").select("node", F.col("least").alias("component"), "size")
    loops = every.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("component"))
    return real.unionByName(loops.join(real, "node", "left_anti").withColumn("size", F.lit(1).cast("bigint")))


def topo_wave(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, wave): the longest path from any node with no inputs; null on and behind cycles."""
    ids = nodes.select("node").distinct()
    a, b = ids.withColumnRenamed("node", "src"), ids.withColumnRenamed("node", "dst")
    return longest_paths(_pairs(edges).join(a, "src", "left_semi").join(b, "dst", "left_semi"), ids)


def components(edges: DataFrame) -> DataFrame:
    """(node, component, size): connected parts, named by their smallest node.

    Alternates two star rewrites: link every larger neighbour to the smallest one, then every
    smaller neighbour. Both are a min aggregate and a join, so a hub is never gathered in one place.
    """
    steps = cut(edges.select(
        F.greatest("src", "dst").alias("big"), F.least("src", "dst").alias("small")
    ).where("big <> small").distinct())
    loops = edges.where("src = dst").select(F.col("src").alias("node")).distinct()
    while True:
        rows = 2 * steps.count()
        both = steps.select(F.col("big").alias("u"), F.col("small").alias("v")).unionByName(
            steps.select(F.col("small").alias("u"), F.col("big").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = cut(sized(both.where("v > u").join(low, "u").select(F.col("v").alias("big"), F.col("m").alias("small")).where("big <> small"), rows))
        least = large.groupBy("big").agg(F.min("small").alias("m"))
        joined = sized(large.join(least, "big"), rows)
        small = joined.select(F.col("small").alias("big"), F.col("m").alias("small")).unionByName(
            sized(least.select("big", F.col("m").alias("small")), rows)).where("big <> small").distinct()
        steps = cut(sized(small, rows))
        # Done exactly when every part is a star: no node has two parents, and no parent has one itself.
        ends = steps.select(F.explode(F.array(F.struct(F.col("big").alias("node"), F.lit(1).alias("up")), F.struct(F.col("small").alias("node"), F.lit(0).alias("up")))).alias("e"))
        open_ = ends.groupBy("e.node").agg(F.sum("e.up").alias("ups"), F.min("e.up").alias("least")).where("ups > 1 or (ups = 1 and least = 0)")
        if sized(open_, rows).isEmpty():
            break
    member = steps.select(F.col("big").alias("node"), F.col("small").alias("component"))
    own = steps.select(F.col("small").alias("node"), F.col("small").alias("component")).distinct()
    named = member.unionByName(own)
    alone = loops.join(named, "node", "left_anti").withColumn("component", F.col("node"))
    named = named.unionByName(alone)
    sizes = named.groupBy("component").agg(F.count("*").alias("size"))
    return named.join(sizes, "component").select("node", "component", "size")


def module_layout(edges: DataFrame, columns: DataFrame) -> DataFrame:
    """Per active column: its level inside its own table, its degree, and whether it stands alone."""
    place = columns.select(F.col("column_id").alias("node"), "table_id")
    a = place.select(F.col("node").alias("src"), F.col("table_id").alias("t1"))
    b = place.select(F.col("node").alias("dst"), F.col("table_id").alias("t2"))
    inside = cut(edges.select("src", "dst", "kind").join(a, "src").join(b, "dst").where("t1 = t2").select("src", "dst", "kind"))
    degree = inside.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    waves = topo_wave(inside, place)
    return place.join(waves, "node").join(degree, "node", "left").select(
        "table_id", "node", F.col("wave").alias("level"), F.coalesce("degree", F.lit(0)).alias("degree"),
        F.col("degree").isNull().alias("isolated"),
    )


# --- exact rerun order -----------------------------------------------------------

_ORDER = "root long, node long, seq int"
GROUP_LIMIT = 100_000  # affected columns of one root that a task orders in memory


BATCH_ROWS = 50_000  # affected columns, of many roots, that a task orders at a time


def _ordered_groups(key, nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """Per root, always take the ready column that comes first in canonical order; what a cycle blocks goes last."""
    rows = nodes.sort_values(["root", "table_position", "position", "node"], na_position="first").reset_index(drop=True)
    roots, names = rows["root"].tolist(), rows["node"].tolist()
    at = {pair: i for i, pair in enumerate(zip(roots, names))}
    waits = [0] * len(names)
    out: dict[int, list[int]] = {}
    for r, s, d in zip(edges["root"].tolist(), edges["src"].tolist(), edges["dst"].tolist()):
        to = at[r, d]
        out.setdefault(at[r, s], []).append(to)
        waits[to] += 1
    order: list[int] = []
    seq: list[int] = []
    first = 0
    while first < len(roots):
        root, end = roots[first], first
        while end < len(roots) and roots[end] == root:
            end += 1
        heap = [i for i in range(first, end) if waits[i] == 0]  # in order, so a heap
        while heap:
            i = heapq.heappop(heap)
            order.append(i)
            for to in out.get(i, ()):
                waits[to] -= 1
                if waits[to] == 0:
                    heapq.heappush(heap, to)
        order += [i for i in range(first, end) if waits[i] > 0]
        seq += range(1, end - first + 1)
        first = end
    return pd.DataFrame({"root": [roots[i] for i in order], "node": [names[i] for i in order], "seq": seq})


def _ordered_in_tasks(nodes: DataFrame, inner: DataFrame, rows: int) -> DataFrame:
    """Roots are dealt into batches of some `BATCH_ROWS` rows, for a call per root costs more than ordering it."""
    batch = F.pmod(F.xxhash64("root"), F.lit(rows // BATCH_ROWS + 1)).alias("batch")
    return nodes.groupBy(batch).cogroup(inner.groupBy(batch)).applyInPandas(_ordered_groups, _ORDER)


def rerun_order(edges: DataFrame, affected: DataFrame, limit: int = GROUP_LIMIT) -> DataFrame:
    """(root, node, seq): the exact order in which each root's affected columns should be rerun.

    `affected`: root, node, table_position, position. Roots are ordered side by side, a batch of small ones
    per call. A root whose set exceeds `limit` is ordered in rounds by joins instead, with the same result.
    """
    nodes = cut(affected.select("root", "node", "table_position", "position").distinct())
    start = nodes.select(F.col("root").alias("root"), F.col("node").alias("src"))
    end = nodes.select(F.col("root").alias("root"), F.col("node").alias("dst"))
    inner = _pairs(edges).join(start, "src").join(end, ["root", "dst"], "left_semi").select(
        F.col("root").alias("root"), "src", "dst"
    )
    sizes = nodes.groupBy("root").agg(F.count("*").alias("n"))
    wide = cut(sizes.where(F.col("n") > limit).select("root"))
    rows = nodes.count()
    if wide.isEmpty():
        return _ordered_in_tasks(nodes, inner, rows)
    small = _ordered_in_tasks(nodes.join(wide, "root", "left_anti"), inner.join(wide, "root", "left_anti"), rows)
    return small.unionByName(_ordered_in_rounds(nodes.join(wide, "root", "left_semi"), inner.join(wide, "root", "left_semi")))


def _ordered_in_rounds(nodes: DataFrame, inner: DataFrame) -> DataFrame:
    """The same order for wide sets, a batch per round.

    Ready columns that come before every column still waiting can all be taken at once, in canonical
    order; when there is none, the first ready column is taken alone.
    """
    key = F.struct("table_position", "position", "node")
    left, links = cut(nodes.withColumn("k", key)), cut(inner)
    taken: list[DataFrame] = []
    batch = 0
    while not left.isEmpty():
        waits = links.select("root", F.col("dst").alias("node"), F.lit(True).alias("waits")).distinct()
        state = cut(left.join(waits, ["root", "node"], "left"))
        bounds = state.groupBy("root").agg(
            F.min(F.when(F.col("waits").isNull(), F.col("k"))).alias("first_ready"),
            F.min(F.when(F.col("waits"), F.col("k"))).alias("first_waiting"),
        )
        judged = state.join(bounds, "root").where("waits is null").where(
            F.col("first_waiting").isNull() | (F.col("k") < F.col("first_waiting")) | (F.col("k") == F.col("first_ready"))
        )
        now = cut(judged.select("root", "node", "k"))
        if now.isEmpty():
            break
        taken.append(now.withColumn("batch", F.lit(batch)))
        batch += 1
        done = now.select("root", "node")
        left = cut(left.join(done, ["root", "node"], "left_anti"))
        links = cut(links.join(done.withColumnRenamed("node", "src"), ["root", "src"], "left_anti"))
    taken.append(left.select("root", "node", "k").withColumn("batch", F.lit(batch)))
    w = Window.partitionBy("root").orderBy("batch", "k")
    return _union(taken).select("root", "node", F.row_number().over(w).alias("seq"))


# --- building edges ---------------------------------------------------------------


def build_ref_edges(refs: DataFrame, declared: DataFrame) -> DataFrame:
    """In-table edges from resolved references plus declared ones, without self-references.

    `refs` and `declared`: column_id (the reader), upstream_id.
    """
    both = refs.select("column_id", "upstream_id").unionByName(declared.select("column_id", "upstream_id"))
    return both.where("upstream_id is not null and column_id <> upstream_id").distinct().select(
        F.col("upstream_id").alias("src"), F.col("column_id").alias("dst"), F.lit("intra_table_ref").alias("kind")
    )


def build_parameter_edges(parameters: DataFrame, targets: DataFrame) -> DataFrame:
    """From a parameter's source column to every column that a binding reaches."""
    source = parameters.where("source_column_id is not null").select("parameter_id", F.col("source_column_id").alias("src"))
    reached = targets.select("parameter_id", F.col("column_id").alias("dst")).distinct()
    return source.join(reached, "parameter_id").where("src <> dst").select(
        "src", "dst", F.lit("cross_table_parameter").alias("kind"), "parameter_id"
    )


def build_advisory_edges(declared: DataFrame, vertices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, declarations that match no column). `declared`: matter_id, column_id, table_name, column_name."""
    from specaudit.functions.normalise import norm_name

    known = vertices.groupBy(
        "matter_id", norm_name(F.col("table_name")).alias("t_key"), norm_name(F.col("name")).alias("c_key")
    ).agg(F.min("column_id").alias("src"))
    keyed = declared.withColumns({"t_key": norm_name(F.col("table_name")), "c_key": norm_name(F.col("column_name"))})
    joined = keyed.join(known, ["matter_id", "t_key", "c_key"], "left")
    edges = joined.where("src is not null").select("src", F.col("column_id").alias("dst"), F.lit("advisory").alias("kind")).distinct()
    missing = joined.where("src is null").select("matter_id", "column_id", "table_name", "column_name")
    return edges, missing


def positions(vertices: DataFrame, node: Column | str = "column_id") -> DataFrame:
    return vertices.select(F.col("column_id").alias("node"), "table_position", "position")
