import random

from specaudit.operators.consistency import entity_variants
from specaudit.operators.patterns import PIECE, candidates
from specaudit.operators.references import find_refs
from specaudit.operators.relational import text_sites


def pairs(spark, texts, values):
    t = spark.createDataFrame(texts, "group_id long, text_id long, body string")
    v = spark.createDataFrame(values, "group_id long, value_id long, value string")
    found = candidates(t, v).collect()
    assert len(found) == len(set(found))
    bodies, looked = {(g, i): b for g, i, b in texts}, {(g, i): x for g, i, x in values}
    want = {(g, i, k) for (g, i), b in bodies.items() for (h, k), x in looked.items() if g == h and b and x and x in b}
    got = {(r.group_id, r.text_id, r.value_id) for r in found}
    assert want <= got
    return len(got), len(want)


def test_candidates_hold_every_pair_and_few_others(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdeé😀") for _ in range(rng.randint(1, 9)))
    texts = [(g, i, " ".join(word() for _ in range(rng.choice([0, 3, 40])))) for i in range(120) for g in [1 if i % 3 else i % 7]]
    # A value across the border of two pieces, and one at the end of a long text.
    texts += [(9, 900, "x" * (PIECE - 3) + "needle in " + "y" * PIECE), (9, 901, "z" * (3 * PIECE) + "last words"), (9, 902, None), (9, 903, "")]
    values = [(g, 1000 + i, rng.choice([word(), word() + " " + word(), rng.choice(texts[:100])[2][5:25]])) for i in range(90) for g in [1 if i % 3 else i % 7]]
    values += [(9, 1, "needle in"), (9, 2, "last words"), (9, 3, ""), (9, 4, None), (9, 5, "nowhere at all"), (9, 6, "z" * 5000)]
    got, want = pairs(spark, texts, values)
    assert want > 50 and got < 2 * want


def test_nothing_to_look_up(spark):
    assert pairs(spark, [(1, 1, "text")], [(1, 1, None)]) == (0, 0)
    assert pairs(spark, [], [(1, 1, "value")]) == (0, 0)
    assert pairs(spark, [(1, 1, "ab")], [(2, 1, "ab"), (1, 2, "abc"), (1, 3, "b")]) == (1, 1)


def test_text_sites_of_a_large_matter_without_comparing_everything(spark):
    """One matter with a third of all rows: as many candidates as hits, not texts times values."""
    rows = [(1 if i % 3 == 0 else i + 1000, i % 50, i, "column_prompt", "1", f"The cap is {i} Dollars, or CODE-{i % 40}.") for i in range(600)]
    texts = spark.createDataFrame(rows, "matter_id long, table_id long, column_id long, site string, version string, text string")
    values = spark.createDataFrame([(1, p, f"code-{p}.") for p in range(400)] + [(1, 900, ""), (1, 901, None)], "matter_id long, parameter_id long, value string")
    bound = spark.createDataFrame([(5, 0, 0, "column_prompt"), (6, 6, None, "table_instructions")], "parameter_id long, table_id long, column_id long, site string")
    got = text_sites(values, texts, bound)
    want = {(i % 40, i) for i in range(0, 600, 3)}
    assert {(r.parameter_id, r.column_id) for r in got.collect()} == want
    assert all(r.occurrences == 1 for r in got.collect())


def test_entity_forms_are_found_through_their_longest_word(spark):
    texts = spark.createDataFrame([
        (1, 1, 1, "column_prompt", "acme  holdings, Inc. and ACME HOLDINGS"), (1, 1, 2, "column_prompt", "Holdings of another kind"), (2, 2, 3, "column_prompt", "Acme Holdings LLC")],
        "matter_id long, table_id long, column_id long, site string, text string")
    names = spark.createDataFrame([(1, "Acme Holdings, LLC"), (1, "Acme Holdings, LLC"), (2, "Acme Holdings LLC")], "matter_id long, name string")
    got = sorted((r.matter_id, r.column_id, r.variant) for r in entity_variants(texts, names).collect())
    assert got == [(1, 1, "ACME HOLDINGS"), (1, 1, "acme holdings, Inc.")]


def test_a_very_long_name_costs_its_own_table_alone(spark):
    long = "Total " + "x" * 10_000
    names = spark.createDataFrame([(1, 1, long, 1), (1, 2, "Total", 2), (2, 3, "Total", 1), (2, 4, "Total Fee", 2), (2, 5, None, 3)], "table_id long, column_id long, name string, position int")
    texts = spark.createDataFrame([(1, 1, f"Add @{long.upper()} and @total."), (2, 2, "Add @Total Fees, @TOTAL FEE, @Totally and @Total"), (3, 3, "No names: @Total here")], "text_id long, table_id long, text string")
    got = sorted((r.text_id, r.start_at, r.resolved_id, r.raw) for r in find_refs(texts, names).collect())
    assert [g[:3] for g in got] == [(1, 5, 1), (1, 10017, 2), (2, 5, 3), (2, 18, 4), (2, 30, None), (2, 43, 3), (3, 11, None)]
    assert got[0][3] == long.upper() and got[2][3] == "Total" and got[4][3].startswith("Totally")
