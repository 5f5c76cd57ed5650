"""Rake and compress: graphs are taken apart from their ends and along their chains, so few rounds meet long paths.

A round takes off the nodes with nothing before or after them, and bridges nodes with one edge in and one edge out by an
edge that stands for both. Of neighbouring chain nodes the one with the larger hash goes, so about a third of every chain
goes per round: trees, chains and rings take a number of rounds that grows with the logarithm of their size, not with
their depth. What was taken off is put back in the opposite order, each time by a join with the nodes already known.

Edges and nodes stay rows; every round is an aggregate by node and a few equi-joins, and its table is written to the shared
folder, so lineage stays short and a lost executor costs one round at most. Spent rounds are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specaudit.session import cut, discard

ROWS_PER_TASK = 50_000


def sized(df: DataFrame, rows: int) -> DataFrame:
    """No more tasks than the rows of an iterative round are worth."""
    most = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = rows // ROWS_PER_TASK + 1
    return df.coalesce(tasks) if tasks < most else df


def _ends(edges: DataFrame, rows: int) -> DataFrame:
    """(node, n_in, n_out, pred, w_in, succ, w_out): what meets at each node; pred and succ mean something where there is one."""
    halves = edges.select(F.explode(F.array(
        F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o"), F.col("src").alias("p"), F.col("w").alias("pw"), F.lit(None).cast("long").alias("s"), F.lit(None).cast("long").alias("sw")),
        F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o"), F.lit(None).cast("long").alias("p"), F.lit(None).cast("long").alias("pw"), F.col("dst").alias("s"), F.col("w").alias("sw")),
    )).alias("h")).select("h.*")
    return sized(halves.groupBy("node").agg(
        F.sum("i").alias("n_in"), F.sum("o").alias("n_out"), F.max("p").alias("pred"), F.max("pw").alias("w_in"), F.max("s").alias("succ"), F.max("sw").alias("w_out")), rows)


def _chain(ends: DataFrame, rows: int, turn: int) -> DataFrame:
    """Nodes with one edge in and one out, none of them neighbours, and no neighbour an end itself.

    Hashes change with each turn, for what stays between the largest ones would be in order, and go one by one.
    """
    inner = ends.where("n_in = 1 and n_out = 1 and pred <> node and succ <> node")
    order = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)), F.col(c))
    near = inner.select("node", F.explode(F.array("pred", "succ")).alias("other"))
    state = ends.select(F.col("node").alias("other"), (F.expr("n_in = 1 and n_out = 1 and pred <> node and succ <> node")).alias("inner"), F.expr("n_in = 0 or n_out = 0").alias("end"))
    beaten = near.join(state, "other").where(F.col("end") | (F.col("inner") & (order("other") > order("node")))).select("node").distinct()
    return sized(inner.join(beaten, "node", "left_anti"), rows)


def _without(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone.select(F.col("node").alias("src")), "src", "left_anti").join(gone.select(F.col("node").alias("dst")), "dst", "left_anti")


def contracted(edges: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(core, rounds) of (src, dst) edges without loops, for questions about cycles.

    `core`: the edges that neither raking nor bridging takes off. `rounds`: (node, pred, succ) of the nodes bridged, in the
    order in which they went. Raked nodes are on no cycle of what was left.
    """
    left, rounds = cut(edges.select("src", "dst", F.lit(1).cast("long").alias("w"))), []
    n = left.count()
    while n:
        ends = cut(_ends(left, n))
        chain = cut(_chain(ends, n, len(rounds)).select("node", "pred", "succ"))
        gone = ends.where("n_in = 0 or n_out = 0").select("node").unionByName(chain.select("node"))
        bridges = chain.where("pred <> succ").select(F.col("pred").alias("src"), F.col("succ").alias("dst"), F.lit(1).cast("long").alias("w"))
        after = cut(sized(_without(left, gone).unionByName(bridges).distinct(), n))
        discard(left, ends)
        left, before, n = after, n, after.count()
        rounds.append(chain)
        if n == before:
            break
    return left.select("src", "dst"), rounds


def bridged(members: DataFrame, rounds: list[DataFrame]) -> DataFrame:
    """(node, component): `members` and the bridged nodes that are in a component, named by any of its nodes.

    A bridged node is on a cycle exactly if the nodes beside it are one or are in one component.
    """
    known = cut(members.select("node", "component"))
    for chain in reversed(rounds):
        side = lambda c: known.select(F.col("node").alias(c), F.col("component").alias(f"{c}_component"))
        both = chain.join(side("pred"), "pred", "left").join(side("succ"), "succ", "left").select(
            "node", "pred", F.coalesce("pred_component", "pred").alias("component"), F.coalesce("succ_component", "succ").alias("other")).where("component = other")
        joined = both.select(F.explode(F.array("node", "pred")).alias("node"), "component")
        after = cut(sized(known.unionByName(joined).distinct(), 0))
        discard(known)
        known = after
    return known


def longest_paths(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, wave): the longest path to each node from any without inputs, by composing (max, +) along chains.

    Null on cycles and behind them. `edges`: distinct (src, dst) with both ends in `nodes`; a loop is a cycle.
    """
    left = cut(edges.select("src", "dst", F.lit(1).cast("long").alias("w")))
    base = cut(nodes.select("node", F.lit(0).cast("long").alias("b")).where("false"))
    known: list[DataFrame] = []  # (node, wave)
    waiting: list[tuple[DataFrame, DataFrame]] = []  # (node, b, src, w) of ends and of chain nodes, whose inputs are known later
    spent, n = [left, base], left.count()
    while n:
        ends = cut(_ends(left, n).join(base, "node", "left").withColumn("low", F.coalesce("b", F.lit(0))).drop("b"))
        spent.append(ends)
        first = ends.where("n_in = 0").select("node", F.col("low").alias("wave"))
        if first.isEmpty():
            break  # all that is left is on a cycle or behind one
        chain = cut(_chain(ends, n, len(waiting)))
        known.append(first)
        last = left.join(ends.where("n_out = 0").select(F.col("node").alias("dst"), "low"), "dst")
        waiting.append((last.select(F.col("dst").alias("node"), F.col("low").alias("b"), "src", "w"), chain.select("node", F.col("low").alias("b"), F.col("pred").alias("src"), F.col("w_in").alias("w"))))
        pushed = left.join(first.select(F.col("node").alias("src"), "wave"), "src").select(F.col("dst").alias("node"), (F.col("wave") + F.col("w")).alias("b"))
        pushed = pushed.unionByName(chain.where("low > 0").select(F.col("succ").alias("node"), (F.col("low") + F.col("w_out")).alias("b")))
        gone = ends.where("n_in = 0 or n_out = 0").select("node").unionByName(chain.select("node"))
        more = cut(sized(base.unionByName(pushed).groupBy("node").agg(F.max("b").alias("b")).join(gone, "node", "left_anti"), n))
        bridges = chain.select(F.col("pred").alias("src"), F.col("succ").alias("dst"), (F.col("w_in") + F.col("w_out")).alias("w"))
        after = cut(sized(_without(left, gone).unionByName(bridges).groupBy("src", "dst").agg(F.max("w").alias("w")), n))
        # Nodes that have lost all their edges at once have heard from all their inputs.
        still = after.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        alone = ends.join(gone, "node", "left_anti").join(still, "node", "left_anti").join(more, "node", "left")
        known.append(alone.select("node", F.coalesce("b", F.lit(0)).alias("wave")))
        spent += [chain, more, after]
        left, base, n = after, more, after.count()
    done = left.select(F.explode(F.array("src", "dst")).alias("node")).distinct().select("node", F.lit(None).cast("long").alias("wave"))
    for more in known:
        done = done.unionByName(more)
    done = cut(done)
    for late, chain in reversed(waiting):
        spent.append(done)
        both = done.unionByName(_heard(chain, done))
        done = cut(both.unionByName(_heard(late, both)))
    discard(*spent)
    return nodes.select("node").distinct().join(done.withColumn("seen", F.lit(True)), "node", "left").select(
        "node", F.when(F.col("seen"), F.col("wave")).otherwise(F.lit(0)).cast("int").alias("wave"))


def _heard(late: DataFrame, done: DataFrame) -> DataFrame:
    """(node, wave) of nodes whose inputs are all known."""
    heard = late.join(done.select(F.col("node").alias("src"), "wave"), "src").groupBy("node").agg(
        F.max("b").alias("b"), F.max(F.col("wave") + F.col("w")).alias("wave"), F.count_if(F.col("wave").isNull()).alias("shut"))
    return heard.select("node", F.when(F.col("shut") == 0, F.greatest("b", "wave")).alias("wave"))
