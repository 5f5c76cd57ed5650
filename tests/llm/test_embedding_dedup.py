import math

import numpy as np
import pytest

from specaudit.llm import embedding_dedup as E


def table(spark, rows, kind="array<float>"):
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, f"vec_id long, embedding {kind}").select("*", *(F.lit("x").alias(c) for c in ("label", "fp", "d", "raw", "key", "rep", "units")))


def brute(rows, cosine=0.95):
    good = {}
    for i, (_, v) in enumerate(rows):
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            a = np.array(v, float)
            good[i] = a / np.abs(a).max()
    links = {i: [j for j, b in good.items() if j != i and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= cosine] for i, a in good.items()}
    out = []
    for i, (vec, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((vec, len(links.get(i, [])), least, vec == least))
    return sorted(out, key=repr)


def groups(seed, n=150, d=16, spread=0.15):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        base = rng.normal(size=d)
        for _ in range(rng.choice([1, 1, 1, 2, 6])):
            rows.append((len(rows), (base + spread * rng.normal(size=d)).astype(np.float32).tolist()))
    return rows


@pytest.mark.parametrize("chunk", [512, 5])
def test_links_match_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(E, "CHUNK", chunk)
    rows = groups(chunk)
    rows += [(9000 + k, rows[3][1]) for k in range(12)] + [(None, rows[3][1]), (9100, [0.0] * 16), (9101, None), (9102, []), (9103, [1.0] * 15 + [None]), (9104, [float("nan")] * 16), (9105, [1.0, 2.0]), (9106, [2.0, 4.0]), (9107, [float("inf")] * 16), (9107, rows[5][1])]
    got = sorted((tuple(r) for r in E.near_duplicates(table(spark, rows)).collect()), key=repr)
    want = brute(rows)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert all(g[1] <= w[1] for g, w in zip(got, want))
    assert sum(g[1] for g in got) >= 0.99 * sum(w[1] for w in want)
    if chunk == 512:
        assert got == want


def test_double_precision_and_extremes(spark):
    rows = [(1, [1e300, 1e300]), (2, [1e-300, 1e-300]), (3, [1.0, 1.0 + 1e-12]), (4, [0.1, -0.1])]
    got = sorted(tuple(r) for r in E.near_duplicates(table(spark, rows, "array<double>")).collect())
    assert got == [(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 0, 4, True)]


def test_empty(spark):
    assert E.near_duplicates(table(spark, [])).collect() == []
    assert [tuple(r) for r in E.near_duplicates(table(spark, [(1, None)])).collect()] == [(1, 0, 1, True)]


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(4)
    d = 64
    units, _ = E.unit(rng.normal(size=(400, d)))
    sign, factor = E.codes(units)
    queries, _ = E.unit(units[:200] + 0.1 * rng.normal(size=(200, d)))
    value, error = E.estimated(sign, factor, queries @ E.rotation(d, 0).T)
    off = value - queries @ units.T
    assert abs(off.mean()) < 0.01
    assert (np.abs(off) <= 4 * error).mean() > 0.999


def test_plan_meets_the_recall_asked_for():
    for n in (10, 10_000, 10**9):
        bits, bands = E.plan(n)
        agree = (1 - math.acos(0.95) / math.pi) ** bits
        assert 1 - (1 - agree) ** bands >= E.RECALL
