import binascii
import random

import numpy as np
import pyarrow as pa
from helpers import documents

from specaudit.llm import gru
from specaudit.llm import language_id as L

LETTERS = {"aa": "abcde", "bb": "fghij", "cc": "éüñöà"}


def rows(seed=0, n=240):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(LETTERS))
        text = " ".join("".join(rng.choice(LETTERS[lang]) for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(3, 30)))
        out.append((i, text, None if i % 17 == 0 else lang))
    return out


def test_held_out_documents_get_their_language(spark):
    data = rows()
    edges = [(5000, None, "aa"), (5001, "", "bb"), (5002, "12 %% … 34", "aa"), (None, "abcde abba", "aa"), (5003, "fghij" * 20_000, None), (5003, "fgh", None)]
    docs = documents(spark, data + edges, lang=True)
    model = L.learnt(docs, sample_docs=60, sample_words=400, hidden=8, epochs=4)
    got = L.identified(docs, model).collect()
    assert len(got) == len(data) + len(edges)
    by = {r.doc_id: r for r in got}
    for i, text, lang in data:
        assert by[i].held_out == (binascii.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= by[i].score <= 1
    right = [by[i].lang_pred == lang for i, _, lang in data if by[i].held_out and lang]
    assert np.mean(right) > 0.97
    for i in (5000, 5001, 5002):
        assert (by[i].lang_pred, by[i].score, by[i].n_positions) == ("und", 0.0, 0)
    assert by[None].lang_pred == "aa" and by[None].held_out is False
    assert by[5003].lang_pred == "bb"

    kept = L.in_known_language(docs, model)
    assert kept.columns == docs.columns
    gone = {5000, 5001, 5002}
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((d for d, *_ in data + edges if d not in gone), key=repr)


def test_nothing_to_learn_from(spark):
    docs = documents(spark, [(1, "abc", None), (2, "def", None)], lang=True)
    assert {(r.lang_pred, r.score) for r in L.identified(docs).collect()} == {("und", 0.0)}
    assert L.identified(documents(spark, [], lang=True)).collect() == []


def test_pooled_probabilities_match_one_text_at_a_time():
    model = L.Model(("a", "b", "c"), gru.init(6, 3, seed=2))
    texts = ["", None, "ab cd ab", "x" * 60 + " y", "1 2 é"]
    data, starts, ends, first = L.windows(pa.array(texts))
    sums, row = L._Memo(model)(data, starts, ends)
    for i, text in enumerate(texts):
        want = np.zeros(4)
        for word in (text or "").lower().encode().split():
            for at in range(0, len(word), L.WINDOW):
                codes = np.frombuffer(word[at : at + L.WINDOW], np.uint8)[None]
                prob, _ = gru.probabilities(model.params, codes)
                for t, c in enumerate(codes[0]):
                    if chr(c).isalpha() and c < 128 or c >= 128:
                        want += np.concatenate(([1], prob[t, 0]))
        assert np.allclose(sums[row[first[i] : first[i + 1]]].sum(0), want, atol=1e-5)


def test_memo_can_overflow(monkeypatch):
    model = L.Model(("a", "b"), gru.init(4, 2))
    memo, fresh = L._Memo(model), L._Memo(model)
    monkeypatch.setattr(L, "MEMO", 3)
    for text in ("aa bb cc dd ee", "aa ff", "aa bb gg hh"):
        data, starts, ends, _ = L.windows(pa.array([text]))
        sums, row = memo(data, starts, ends)
        fresh._clear()
        want, own = fresh(data, starts, ends)
        assert np.allclose(sums[row], want[own])


def test_gradients_match_finite_differences():
    rng = np.random.default_rng(0)
    p = {k: v.astype(float) for k, v in gru.init(5, 3, seed=1).items()}
    codes, labels = rng.integers(0, 256, (4, 6)), np.array([0, 1, 2, 1])
    weights = rng.random((4, 6))
    _, grad = gru.gradients(p, codes, labels, weights)
    for name in p:
        for _ in range(5):
            at = (codes[rng.integers(4), rng.integers(6)], rng.integers(15)) if name[0] == "x" else tuple(rng.integers(0, s) for s in p[name].shape)
            keep, e = p[name][at], 1e-6
            p[name][at] = keep + e
            up = gru.gradients(p, codes, labels, weights)[0]
            p[name][at] = keep - e
            down = gru.gradients(p, codes, labels, weights)[0]
            p[name][at] = keep
            assert abs(grad[name][at] - (up - down) / (2 * e)) < 1e-6
