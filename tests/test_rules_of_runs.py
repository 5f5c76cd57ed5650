"""Rules come straight from the runs that headings were filled in, with one exchange of the texts."""

import random

from specaudit.functions.normalise import strip
from specaudit.operators import documents as D

BLOCK = "playbook_id long, edition int, seq long, is_heading boolean, text string"
LINES = [(True, t) for t in ("Caps", " Term\t", "Preamble:", "Standard position", "Guidance", "Acceptable deviations:", "Required", "Optional")] + [
    (False, t) for t in ("one", " two ", "", "yes", "no", "Rule ID: a.1", "three four")]


def blocks_of(rnd):
    return [(k, e, s, *rnd.choice(LINES)) for k in range(70) for e in (1, 2) for s in sorted(rnd.sample(range(60), rnd.randrange(1, 40)))]


def test_rules_of_runs_are_those_of_the_filled_blocks(spark, monkeypatch):
    blocks = spark.createDataFrame(blocks_of(random.Random(3)), BLOCK)
    want = sorted(map(repr, D.parse_rules(D.heading_fill(blocks)).collect()))  # with each document in one run
    assert len(want) > 100
    for chunk in (1, 5, 16, 4096):
        monkeypatch.setattr(D, "_CHUNK", chunk)
        runs = D.heading_runs(blocks)
        assert sorted(map(repr, D.rules_of_runs(runs).collect())) == want
        assert sorted(map(repr, D.parse_rules(D.fill_of_runs(runs)).collect())) == want


def test_filled_blocks_are_those_of_one_pass(spark, monkeypatch):
    monkeypatch.setattr(D, "_CHUNK", 7)
    rows = blocks_of(random.Random(4))
    want, at = [], None
    for k, e, s, head, text in rows:
        if at != (k, e):
            at, own, fld = (k, e), None, None
        title = text.strip()
        key = title.lower().rstrip(":")
        if not head:
            mine = fld if fld and fld[0] > (own[0] if own else -1) else None
            kind = own[1] if own else None
            want.append((k, e, s, own and own[0], kind, own and own[2], mine[1] if mine and kind == "rule" else None, mine and mine[0], title))
        elif key in D.vocab.FIELD_HEADINGS:
            fld = (s, D.vocab.FIELD_HEADINGS[key])
        else:
            own = (s, "preamble" if key in D.vocab.PREAMBLE_HEADINGS else "rule", title)
    got = D.heading_fill(spark.createDataFrame(rows, BLOCK))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_strip_takes_what_the_unicode_class_matches(spark):
    from pyspark.sql import functions as F

    one = spark.range(1, 0x10000).where("id not between 55296 and 57343").select(F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')").alias("c"))
    row = one.select(F.concat("c", F.lit("a\n b"), "c", "c", F.lit("\n")).alias("t"))
    assert row.where(strip(F.col("t")) != F.regexp_replace("t", r"(?U)^\s+|\s+$", "")).count() == 0

