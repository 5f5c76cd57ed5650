"""Texts of rules that nothing is compared with are not sent out, and what is compared stays the same."""

from specaudit.operators import documents as D

LINES = [
    (True, "Preamble"), (False, "For lone notice thirty days and standard supply terms apply."), (True, "Caps"), (True, "Standard position"), (False, "standard liability terms apply here"),
    (True, "Other"), (True, "Standard position"), (False, "nothing compares with this wording"), (True, "Caps Fees"), (True, "Standard position"), (False, "standard liability terms apply here"),
    (True, "Lone notice"), (True, "Standard position"), (False, "thirty days and standard supply terms apply"), (True, "Last"), (True, "Standard position"), (False, "closing words"),
]


def blocks(spark, documents=2):
    rows = [(d, 1, seq, heading, text) for d in range(documents) for seq, (heading, text) in enumerate(LINES)]
    return spark.createDataFrame(rows, "playbook_id long, edition int, seq long, is_heading boolean, text string")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_only_texts_that_are_compared(spark):
    runs = D.heading_runs(blocks(spark), akin=True)
    texts = D.akin_texts(runs)
    assert {r.position for r in texts.collect()} == {1, 3, 4, 5}  # not "Other"; the last heading is always taken
    rules, filled = D.rules_of_runs(D.heading_runs(blocks(spark))), D.heading_fill(blocks(spark))
    assert rows(D.parent_child_duplication(rules, texts)) == rows(D.parent_child_duplication(rules)) != []
    assert rows(D.preamble_restates(rules, filled, texts)) == rows(D.preamble_restates(rules, filled)) != []


def test_documents_of_several_runs_keep_their_texts(spark, monkeypatch):
    monkeypatch.setattr(D, "_CHUNK", 7)
    runs = D.heading_runs(blocks(spark), akin=True)
    texts, rules, filled = D.akin_texts(runs), D.rules_of_runs(D.heading_runs(blocks(spark))), D.heading_fill(blocks(spark))
    assert {r.position for r in texts.collect()} == {1, 2, 3, 4, 5}
    assert rows(D.document_findings(rules, filled, texts)) == rows(D.document_findings(rules, filled)) != []


def test_the_document_audit_writes_no_filled_blocks(spark, monkeypatch):
    from specaudit.plans import documents as P
    from specaudit.plans.registry import result
    from specaudit.sources.views import Model

    seen, write = [], P.cut
    monkeypatch.setattr(P, "cut", lambda df: seen.append(df.columns) or write(df))
    result("document_findings", Model(spark, "/root/testdata/sf0.001"))
    assert seen and not any("owner_seq" in columns for columns in seen)
    assert [*D.DOC, "position", "standard", "acceptable"] in seen
