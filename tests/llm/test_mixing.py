import random
from collections import Counter, defaultdict

import pytest
from helpers import CLASHING, prose
from pyspark.sql import functions as F

from specaudit.llm import mixing as M


def table(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    return df.select("*", *(F.lit("x").alias(c) for c in (*CLASHING, "of", "step", "bar", "rank", "digest")))


def fair(sizes, weights=(1, 2, 3), repeats=3):
    """Targets by sharing again and again what is above a cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped: set = set()
    while True:
        rest = sum(sizes.values()) - sum(repeats * sizes[s] for s in capped)
        free = sum(weight[s] for s in names if s not in capped)
        target = {s: repeats * sizes[s] if s in capped else weight[s] * rest / free for s in names}
        more = {s for s in names if s not in capped and target[s] > repeats * sizes[s]}
        if not more:
            return target
        capped |= more


def check(spark, rows, **options):
    got = M.mixed(table(spark, rows), **options).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, source, text in rows:
        sizes[source] += len((text or "").split())
    target, taken = fair(sizes), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 3 * r.size and r.copies * r.size <= r.taken
        taken[r.source] += r.taken
    for s, t in target.items():
        assert abs(taken[s] - t) <= 0.5 + 1e-6
    return got


def corpus(seed=1):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["big", "big", "big", "a", "é", "z", "\U00010000", "￿", None]), prose(rng, rng.choice([1, 5, 40, 200]))) for i in range(400)]
    return [*rows, (900, "tiny", "one two"), (901, "none", None), (902, "none", ""), (903, "none", " \t"), (904, "big", "w " * 30_000)]


def test_targets_are_met_to_the_word(spark):
    check(spark, corpus())


def test_reruns_and_other_partitions_agree(spark):
    rows = corpus(2) + [(None, "a", "same words here")] * 50 + [(7, "z", "again")] * 30
    key = lambda got: sorted((tuple(r) for r in got), key=repr)
    once = key(check(spark, rows))
    rng = random.Random(3)
    rng.shuffle(rows)
    assert key(M.mixed(table(spark, rows).repartition(7)).collect()) == once


def test_a_boundary_inside_a_group_of_equal_rows(spark):
    rows = [(None, "a", "x y z")] * 60 + [(1, "b", "w " * 100)] + [(2, "c", None)]
    got = check(spark, rows)
    assert len({r.taken for r in got if r.source == "a"}) <= 3  # more, fewer, and one row in part


def test_nested(spark):
    """A larger budget takes whatever a smaller one takes."""
    rows = M.sized(table(spark, corpus(4)[:-1]))
    histogram = rows.groupBy("source", M._bucket().alias("bucket")).agg(F.sum("size").alias("size"))
    budgets = spark.createDataFrame([("big", 1, 10), ("big", 2, 3000), ("big", 3, 6000), ("a", 1, 0)], "of string, step int, budget long")
    bars = {(r.source, r.step): r for r in M.thresholds(rows, histogram, budgets).collect()}
    assert bars["big", 1].bar < bars["big", 2].bar < bars["big", 3].bar
    for r in budgets.collect():
        bar = bars[r.of, r.step]
        below = rows.where((F.col("source") == r.of) & (F.col("key") < bar.bar)).agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        assert below + bar.rest == r.budget



def test_nothing_and_no_words(spark):
    assert M.mixed(table(spark, [])).collect() == []
    got = M.mixed(table(spark, [(1, "a", None), (2, None, " ")])).collect()
    assert sorted((r.doc_id, r.target, r.taken) for r in got) == [(1, 0.0, 0), (2, 0.0, 0)]


def test_plan_has_no_python(spark):
    plan = M.mixed(table(spark, corpus(6)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_equals_sql_at_sf001(spark):
    import duckdb

    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = con.execute(f"SELECT doc_id, size, source_size, target, taken, source, copies FROM ({M.oracle_sql()})").fetchall()
    got = M.mixed(spark.read.parquet(f"{folder}/documents.parquet")).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)
