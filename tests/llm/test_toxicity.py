import binascii
import random

import numpy as np
from helpers import documents, prose

from specaudit.llm import text_cnn
from specaudit.llm import toxicity as X

BAD = {"aa": ["villain", "rotter"], "bb": ["schuft", "lump"]}


def data(seed=0, n=500):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        lang = rng.choice(["aa", "bb"])
        words = prose(rng, rng.randint(5, 40), "abcde" if lang == "aa" else "fghij").split(" ")
        toxic = rng.random() < 0.3
        if toxic:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words) + 1), rng.choice(BAD[lang]))
        rows.append((i, " ".join(words), lang))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_documents_are_told_apart(spark):
    rows, labels = data()
    edges = [(7000, None, "aa"), (7001, "", None), (None, "a villain", "aa"), (7002, "abc de " * 30_000 + "villain", "aa"), (7002, "abc de " * 30_000, "aa")]
    docs = documents(spark, rows + edges, lang=True)
    marks = spark.createDataFrame([*labels, (7000, None), (None, 1), (99_999, 1), (0, None)], "doc_id long, toxic int")
    model = X.learnt(docs, marks, epochs=8)
    got = X.scored(docs, model).collect()
    assert len(got) == len(rows) + len(edges)
    by = {r.doc_id: r for r in got}
    truth = dict(labels)
    held = [i for i in truth if by[i].held_out]
    assert all(by[i].held_out == (binascii.crc32(str(i).encode()) % 5 == 0) for i in truth)
    assert np.mean([by[i].predicted == truth[i] for i in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert by[7000].score == by[7001].score and by[7000].predicted == 0
    assert by[None].held_out is False and by[None].predicted == 1
    assert len({r.score for r in got if r.doc_id == 7002}) == 2  # the last word of a long text counts
    assert np.mean([by[i].guessed_lang == lang for i, _, lang in rows]) > 0.95


def test_thresholds_come_from_all_labelled_rows(spark, monkeypatch):
    rng = random.Random(5)
    rows, labels = data(n=200)
    marks = dict(labels)
    # A sample of 20 + 20 leaves no language many toxic rows to calibrate on; the long texts are never fitted to.
    rows += [(1000 + i, prose(rng, 60, "fghij") + (" lump" if i % 2 else "") + " fgh" * 3000, "bb") for i in range(20)]
    marks |= {i: i % 2 for i in range(1000, 1020)}
    docs = documents(spark, rows, lang=True)
    seen = []
    inner = X._best_threshold
    monkeypatch.setattr(X, "_best_threshold", lambda counts: seen.append(counts) or inner(counts))
    model = X.learnt(docs, spark.createDataFrame(list(marks.items()), "doc_id long, toxic int"), toxic=20, clean=20, epochs=4)
    usable = [i for i, _, _ in rows if binascii.crc32(str(i).encode()) % 5]
    n = np.array([sum(marks[i] == k for i in usable) for k in (0, 1)])
    assert len(model.languages) == 2 and len(seen) == 2
    # Each language has its own counts, and those of all of them as so many toxic rows.
    assert np.allclose(sum(seen).sum(1), n * (1 + 2 * X.PRIOR / n[1])) and all(counts[1].sum() >= X.PRIOR for counts in seen)


def test_a_rare_language_leans_on_the_common_counts():
    common = np.zeros((2, 2 * X.BINS))
    common[0, X.BINS - 20 : X.BINS], common[1, X.BINS : X.BINS + 20] = 50, 50
    own = np.zeros_like(common)
    own[1, X.BINS - 10] = 1  # one toxic row among clean scores
    limit = lambda own: X._best_threshold(own + common * (X.PRIOR / common[1].sum()))
    assert abs(limit(own) - X._best_threshold(common)) < 2 * X.BIN
    own[1, X.BINS - 10], own[0, X.BINS - 30] = 500, 500
    assert limit(own) < X._best_threshold(common) - 5 * X.BIN


def test_best_threshold_matches_trying_every_cut():
    rng = np.random.default_rng(2)
    for _ in range(20):
        counts = np.zeros((2, 2 * X.BINS), int)
        for kind in (0, 1):
            np.add.at(counts[kind], X.BINS + rng.integers(-40, 40, 30) + 15 * kind, 1)

        def f1(low):
            at = (np.arange(2 * X.BINS) - X.BINS) * X.BIN >= low
            return 2 * counts[1, at].sum() / (counts[:, at].sum() + counts[1].sum())

        # A threshold between neighbouring bins is the border of the two.
        assert f1(X._best_threshold(counts)) == max(f1((b - X.BINS) * X.BIN) for b in range(2 * X.BINS))


def test_nothing_to_learn_from(spark):
    docs = documents(spark, [(1, "a b", "aa")], lang=True)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [(r.score, r.predicted) for r in X.scored(docs, X.learnt(docs, none)).collect()] == [(0.0, 0)]
    empty = documents(spark, [], lang=True)
    assert X.scored(empty, X.learnt(empty, none)).collect() == []


def plain_logit(p, words):
    x = p["e"][words].sum(1) if len(words) else np.zeros((0, p["e"].shape[1]))
    pooled = []
    for w in text_cnn.WIDTHS:
        y = np.concatenate([x, np.zeros((max(0, w - len(x)), p["e"].shape[1]))])
        score = [sum(y[t + j] @ p[f"k{w}"][j] for j in range(w)) for t in range(len(y) - w + 1)]
        pooled.append(np.maximum(np.max(score, 0) + p[f"c{w}"], 0))
    return float(np.concatenate(pooled) @ p["v"] + p["b"][0])


def texts(seed=3):
    rng = np.random.default_rng(seed)
    own = [rng.integers(0, 40, (n, 3)) for n in (4, 0, 1, 2, 3, 9, 0, 30, 1)]
    return own, np.concatenate(([0], np.cumsum([len(x) for x in own])))


def test_logits_match_one_text_at_a_time():
    p = {k: v.astype(float) for k, v in text_cnn.init(40, 5, 4, seed=1).items()}
    p["c1"] += 0.05
    own, first = texts()
    distinct, row = np.unique(np.concatenate(own), axis=0, return_inverse=True)
    assert np.allclose(text_cnn.logits(p, distinct, row.ravel(), first), [plain_logit(p, t) for t in own], atol=1e-5)


def test_gradients_match_finite_differences():
    p = {k: v.astype(float) for k, v in text_cnn.init(40, 5, 4, seed=1).items()}
    for w in text_cnn.WIDTHS:
        p[f"c{w}"] += 0.07
    own, first = texts()
    labels, weights = np.array([0, 1, 0, 1, 1, 0, 1, 0, 1]), np.linspace(0.5, 1, 9)
    words = np.concatenate(own)
    loss, grad = text_cnn.gradients(p, words, first, labels, weights)
    z = np.array([plain_logit(p, t) for t in own])
    assert np.isclose(loss, (weights * (np.logaddexp(0, z) - labels * z)).sum())
    rng = np.random.default_rng(5)
    for name in p:
        for _ in range(12):
            at = tuple(rng.integers(0, s) for s in p[name].shape)
            if name == "e" and at[0] == 0:
                continue  # no word
            keep, e = p[name][at], 1e-6
            p[name][at] = keep + e
            up = text_cnn.gradients(p, words, first, labels, weights)[0]
            p[name][at] = keep - e
            down = text_cnn.gradients(p, words, first, labels, weights)[0]
            p[name][at] = keep
            assert abs(grad[name][at] - (up - down) / (2 * e)) < 1e-5
