"""Comparing two editions: texts of rules that match by identity or name are neither taken apart nor sent out."""

from pyspark.sql import functions as F
from test_documents import RULE

from specaudit.operators import documents as D
from specaudit.session import cut


def edition(spark, no, rows):
    return cut(spark.createDataFrame([(1, no, i, name, text, [], ["never"], "", None, rule_id, None) for i, (name, text, rule_id) in enumerate(rows, 1)], RULE))


def both(spark):
    before = edition(spark, 1, [("Caps", "matched liability text", "c"), ("Term", "matched term text", None), ("Old name", "wording about notices stays", None), ("Same", "matched as it was", None)])
    after = edition(spark, 2, [("Liability", "matched liability text", "c"), ("Term", "matched other text", None), ("Fresh name", "wording about notices stays", None), ("Same", "matched as it was", None)])
    return before, after


def test_only_the_rest_is_taken_apart(spark, monkeypatch):
    whole = D.T.content_tokens
    monkeypatch.setattr(D.T, "content_tokens", lambda c: F.when(F.contains(c, F.lit("matched")), F.raise_error(F.lit("taken apart"))).otherwise(whole(c)))
    got = {(r.before, r.after, r.matched_by) for r in D.pair_rules(*both(spark)).collect()}
    assert got == {(1, 1, "rule_id"), (2, 2, "name"), (3, 3, "content"), (4, 4, "name")}


def test_comparisons_send_no_texts(spark):
    before, after = both(spark)
    pairs = cut(D.pair_rules(before, after))
    counts = D.diff_counts(pairs, before, after)
    assert counts.first().asDict() == {"playbook_id": 1, "added": 0, "removed": 0, "renamed": 2, "changed": 1, "unchanged": 2}
    assert "sha2(" in counts._jdf.queryExecution().optimizedPlan().toString()
    assert "standard:" not in D.rename_findings(pairs, before, after)._jdf.queryExecution().executedPlan().toString()
