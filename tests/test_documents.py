import random

from specaudit.operators import documents as D
from specaudit.operators.similarity import near_duplicate_texts, similar_sets

CLEAN = """# Control
Version 3, owner: desk
# Preamble
On exhaustion of every fallback, escalate.
# Term
## Standard position
Three years. If not present, escalate.
## Acceptable deviations
A term of up to 4 years.
## Unacceptable deviations
More than 6 years.
## Guidance
Rule ID: term.main
## Required
Yes"""


def rules_of(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "playbook_id long, text string")
    from pyspark.sql import functions as F

    filled = D.heading_fill(D.parse_rule_blocks(docs).withColumn("edition", F.lit(1)))
    return D.parse_rules(filled), filled


def test_conforming_document_has_no_findings(spark):
    rules, filled = rules_of(spark, [CLEAN])
    r = rules.first()
    assert (r.name, r.position, r.required, r.rule_id, r.acceptable) == ("Term", 1, True, "term.main", ["A term of up to 4 years."])
    assert D.document_findings(rules, filled).collect() == []


def test_findings_of_a_poor_document(spark):
    poor = CLEAN.replace("If not present, escalate.", "").replace("More than 6 years.", "An indefinite term.").replace("Rule ID: term.main", "See the rule on caps.").replace("Version 3, owner: desk", "Notes")
    codes = {r.code for r in D.document_findings(*rules_of(spark, [poor])).collect()}
    assert codes == {"ABSENCE_REMEDIATION_MISSING", "LADDER_GAP", "RULE_ID_MISSING", "PROSE_SUBSTITUTES_FOR_STRUCTURE", "DOCUMENT_CONTROL_MISSING"}


def test_heading_fill_across_runs(spark, monkeypatch):
    monkeypatch.setattr(D, "_CHUNK", 3)
    r = rules_of(spark, [CLEAN])[0].first()
    assert (r.name, r.rule_id, r.unacceptable) == ("Term", "term.main", ["More than 6 years."])


RULE = "playbook_id long, edition int, position int, name string, standard string, acceptable array<string>, unacceptable array<string>, guidance string, required boolean, rule_id string, precedence string"


def jaccard(x, y):
    a, b = ({w for w in t.split() if len(w) > 3} for t in (x, y))
    return len(a & b) / len(a | b)


def brute_pairs(before, after):
    left_b, left_a, out = list(before), list(after), set()
    ids = {r[9]: r for r in left_a if r[9]}
    for b in list(left_b):
        if b[9] and b[9] in ids:
            a = ids.pop(b[9])
            out.add((b[2], a[2], "rule_id"))
            left_b.remove(b), left_a.remove(a)
    names = {r[3].lower(): r for r in left_a}
    for b in list(left_b):
        a = names.pop(b[3].lower(), None)
        if a:
            out.add((b[2], a[2], "name"))
            left_b.remove(b), left_a.remove(a)
    for b in list(left_b):
        scored = [(jaccard(b[4], a[4]), -a[2], a) for a in left_a]
        best = max(scored, default=None)
        if best and best[0] >= 0.6:
            out.add((b[2], best[2][2], "content"))
            left_a.remove(best[2])
    return out


def test_pairing_matches_one_by_one_matching(spark):
    rnd = random.Random(5)
    words = ["alpha", "bravo", "charlie", "delta1", "echoes", "foxtrot", "golfer", "hotel1"]

    def edition(n, no):
        return [(1, no, i, rnd.choice(["Caps", "Term", "Notice"]) + str(rnd.randrange(30)), " ".join(rnd.sample(words, 6)), [], [], "", None,
                 rnd.choice([None, None, f"id{rnd.randrange(20)}"]), None) for i in range(1, n + 1)]

    before, after = edition(14, 1), edition(16, 2)
    got = {(r.before, r.after, r.matched_by) for r in D.pair_rules(spark.createDataFrame(before, RULE), spark.createDataFrame(after, RULE)).collect()}
    assert got == brute_pairs(before, after)


def test_diff_counts_and_removed(spark):
    def rule(no, pos, name, standard, rule_id=None, precedence=None, guidance=""):
        return (1, no, pos, name, standard, [], [], guidance, None, rule_id, precedence)

    before = [rule(1, 1, "Caps", "capped liability applies always", "c"), rule(1, 2, "Term", "term runs three years"), rule(1, 3, "Gone", "vanished wording entirely")]
    after = [rule(2, 1, "Liability caps", "capped liability applies always", "c", guidance="formerly Caps rule"), rule(2, 2, "Term", "term runs four years", precedence="prevails over Gone."), rule(2, 3, "New", "brand fresh content")]
    b, a = spark.createDataFrame(before, RULE), spark.createDataFrame(after, RULE)
    pairs = D.pair_rules(b, a)
    assert tuple(D.diff_counts(pairs, b, a).first()) == (1, 1, 1, 1, 2, 0)
    assert [(r.code, r.by) for r in D.rename_findings(pairs, b, a).collect()] == [("RULE_RENAMED", "rule_id")]
    gone = D.rule_removed(pairs, b, a).first()
    assert (gone.name, gone.referenced_by) == ("Gone", 1)
    said = {(r.name, r.former_name, r.code) for r in D.former_name_mentions(pairs, b, a).collect()}
    assert said == {("Liability caps", "caps", "RENAMED_RULE_SELF_REFERENCE"), ("Term", "gone", "REFERENCE_TO_RENAMED_RULE")}


def test_similar_sets_match_all_pairs(spark):
    rnd = random.Random(8)
    for threshold in (0.6, 0.8):
        sets = {i: sorted(rnd.sample("abcdefghijkl", rnd.randrange(1, 10))) for i in range(60)}
        sets = {min(k for k in sets if sets[k] == v): v for v in sets.values()}
        want = {(a, b) for a in sets for b in sets if a < b and len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])) >= threshold}
        got = {(r.a, r.b) for r in similar_sets(spark.createDataFrame(list(sets.items()), "id long, tokens array<string>"), [], threshold).collect()}
        assert got == want


def test_copies_form_a_star(spark):
    rows = [(i, ["alpha", "bravo"]) for i in range(5)] + [(9, ["delta", "gamma"])]
    got = {(r.a, r.b, r.score) for r in near_duplicate_texts(spark.createDataFrame(rows, "id long, tokens array<string>"), 0.6).collect()}
    assert got == {(0, i, 1.0) for i in range(1, 5)}
