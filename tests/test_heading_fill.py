"""Headings reach over runs of blocks, and the filled blocks of one query are worked out once."""

from specaudit.operators import documents as D
from specaudit.plans import documents as P
from specaudit.sources.views import Model


def test_headings_reach_over_runs(spark, monkeypatch):
    monkeypatch.setattr(D, "_CHUNK", 4)
    lines = [(0, True, "Fees"), (1, False, "a"), (2, True, "Standard position"), (5, False, "b"), (14, False, "c"), (15, True, "Guidance"), (16, False, "d"), (21, True, "Terms"), (30, False, "e")]
    rows = [(k, 1, s, h, t) for k in (1, 2) for s, h, t in lines] + [(3, 1, 9, False, "alone")]
    got = {(r.playbook_id, r.text): (r.heading, r.slot) for r in D.heading_fill(spark.createDataFrame(rows, "playbook_id long, edition int, seq long, is_heading boolean, text string")).collect()}
    want = {"a": ("Fees", None), "b": ("Fees", "standard"), "c": ("Fees", "standard"), "d": ("Fees", "guidance"), "e": ("Terms", None)}
    assert got == {(k, t): v for k in (1, 2) for t, v in want.items()} | {(3, "alone"): (None, None)}


def test_filled_blocks_are_worked_out_once(spark):
    m = Model(spark, "/root/testdata/sf0.001")
    assert P.filled(m) is P.filled(m)
    assert not [f for f in P.filled(m).inputFiles() if "documents.parquet" in f]
