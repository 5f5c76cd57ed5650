import random
from collections import defaultdict

import public_tokenizers
from helpers import prose
from test_ngram_join import brute, brute_sets, near_copies
from test_token_counts_and_packing import check_packing, ids

import corpus_pipeline as P
from specaudit.session import cut, new_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ITEM = "which of these nine odd words would you rather pick up first"


def table(seed=1, n=120):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(["aa", "bb"])
        rows.append((i, prose(rng, rng.randint(20, 120), "abcdeo" if lang == "aa" else "fghiju"), lang))
    rows += [(200 + i, rows[i][1], rows[i][2]) for i in range(10)]  # copies
    rows += [(300, prose(rng, 30, "abcdeo") + " " + ITEM, "aa"), (301, prose(rng, 30, "abcdeo") + " token = 'abcdef123456'", "aa"), (302, "", None), (303, None, "aa"), (304, "12 34 %", "bb")]
    return [(i, t, lang, "s", len(t) if t is not None else None) for i, t, lang in rows]


def folder_of(spark, rows):
    where = new_folder(spark, "test")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where


def test_each_stage_does_its_work_and_keeps_the_rest(spark):
    rows = table()
    where = folder_of(spark, rows)
    docs = spark.read.parquet(f"{where}/documents.parquet")
    seen = {}
    for name, stage in P.STAGES:
        docs = cut(stage(spark, docs, where))
        seen[name] = docs
        if name != "packing":
            assert docs.columns == COLUMNS
    text = {n: {r.doc_id: r.text for r in df.collect()} for n, df in seen.items() if n != "packing"}
    assert set(text["language"]) == {r[0] for r in rows} - {302, 303, 304}
    left = [(i, t) for i, t in text["language"].items()]
    assert set(text["near_copies"]) == {d for d, _, least in brute(left) if d == least}
    assert set(text["near_copies"]) - set(text["benchmarks"]) == {300}
    assert set(text["secrets"]) == set(text["benchmarks"])
    changed = {i for i, t in text["secrets"].items() if t != text["benchmarks"][i]}
    assert changed == {301} and text["secrets"][301].endswith(" [secret]'")
    assert all(r.n_chars == len(r.text) for r in seen["secrets"].collect())
    want = defaultdict(list)
    for i, t in text["secrets"].items():
        want[i].append([*ids(t), 1])
    check_packing(seen["packing"].collect(), want, 2048)


def linked_lower(rows, width, percent):
    """Ids of rows that are not the smallest of their group, by comparing all pairs."""
    sets = brute_sets(rows, width)
    least = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                low, high = sorted((least[i], least[j]))
                least = [low if x == high else x for x in least]
    return {rows[i][0] for i, x in enumerate(least) if x != i}


def test_near_copies_go_at_five_words_and_four_fifths(spark):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(50)]
    rows = [(0, " ".join(base)), (1, " ".join([*base[:25], "other", *base[26:]])), (2, "one two three four"), (3, "one two three four"), (4, None), (5, "")]
    rows += [(10 + i, t) for i, t in near_copies(2, bases=4)] + [(100 + i, prose(rng, 30)) for i in range(10)]
    gone = linked_lower(rows, 5, 80)
    assert 1 in gone and 1 not in linked_lower(rows, 3, 90)
    docs = spark.createDataFrame([(i, t, "aa", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = dict(P.STAGES)["near_copies"](spark, docs, "")
    assert kept.columns == COLUMNS and {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - gone


def test_run_applies_all_stages(spark):
    where = folder_of(spark, table(n=30))
    got = P.run(spark, where)
    assert "ids_crc32" in got.columns and got.count() > 20


def test_an_empty_table_goes_through(spark):
    assert P.run(spark, folder_of(spark, [])).collect() == []


def test_stages_are_registered():
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is P.run and len(P.STAGES) == 5
    assert P.ORACLE_SQL is None and public_tokenizers.path(P.BPE)
