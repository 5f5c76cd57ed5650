import random

from helpers import documents, prose

from specaudit.llm import license_scan as L


def held(text, template):
    """The exact containment in the best window, by brute force."""
    def shingles(t):
        w = L.words_of(t or "")
        return [tuple(w[i : i + L.WORDS]) for i in range(len(w) - L.WORDS + 1)]

    want, own = set(shingles(template)), shingles(text)
    if not want or not own:
        return 0.0
    step = 1
    while step < len(want):
        step *= 2
    return max(len(want & set(own[a : a + 2 * step])) / len(want) for a in range(0, len(own), step))


def test_notices_match_brute_force(spark):
    rng = random.Random(2)
    rows = [(1, None), (2, ""), (3, "license"), (None, "x Released under the MIT License. y"), (None, None)]
    for i, (_, text) in enumerate(L.TEMPLATES):
        words = text.split()
        for k in range(4):
            broken = [w if rng.random() > 0.02 * k else "zz" for w in words]
            rows.append((10 * i + k + 10, " ".join([prose(rng, rng.randint(0, 90)), *broken, prose(rng, 30)])))
    rows += [(900, " ".join(["word"] * 30_000 + [L.TEMPLATES[1][1]])), (901, L.TEMPLATES[0][1] + " " + L.TEMPLATES[2][1]), (901, L.TEMPLATES[0][1])]
    want = {}
    for d, text in rows:
        for name, template in L.TEMPLATES:
            share = held(text, template)
            if share >= L.CONTAINED:
                want[d, name] = max(share, want.get((d, name), 0))
    got = {(r.doc_id, r.license): r.containment for r in L.license_notices(documents(spark, rows)).collect()}
    assert len(want) > 40 and all(got[k] == want[k] for k in got if k in want)
    assert set(got) == set(want), (set(got) ^ set(want), [want.get(k) for k in set(got) ^ set(want)])


def test_anchor_test_loses_nothing():
    words = L.anchors(L.TEMPLATES)
    for _, text in L.TEMPLATES:
        own = L.words_of(text)
        shingles = {tuple(own[i : i + L.WORDS]) for i in range(len(own) - L.WORDS + 1)}
        free = [s for s in shingles if not any(w in words for w in s)]
        assert len(free) < L.CONTAINED * len(shingles)


def test_empty_tables_and_templates(spark):
    assert L.license_notices(documents(spark, [])).collect() == []
    some = documents(spark, [(1, L.TEMPLATES[0][1])])
    assert L.license_notices(some, []).collect() == []
    assert L.license_notices(some, [("X", "too short")]).collect() == []


def test_no_python_in_the_plan(spark):
    plan = L.license_notices(documents(spark, [(1, L.TEMPLATES[0][1])]))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
