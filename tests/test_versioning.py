import random

from specaudit.operators import versioning as V

STORED = "table_id long, column_id long, name string, position int, native_type string, status string, role string, text string, minor long"
BATCH = "table_id long, name string, position int, native_type string, status string, role string, text string"
EVENT = "column_id long, change_no long, name string, status string, role string, concept string, native_type string, text string, bump string, note string"
COLUMN = "column_id long, name string, status string, role string, concept string, native_type string, text string"


def test_merging_twice_changes_nothing_more(spark):
    stored = spark.createDataFrame([(1, 10, "Term", 1, "Date", "verified", None, "old", 0), (1, 11, "Cap", 2, "Date", "retired", None, "cap", 2), (1, 12, "Left", 3, "Date", "draft", None, "x", 1)], STORED)
    batch = spark.createDataFrame([(1, " term ", 1, "Date", None, None, "new"), (1, "Cap", 2, "Date", None, None, "cap"), (1, "Fresh", 4, "Date", None, None, "y")], BATCH)
    first = V.merge_columns(stored, batch)
    assert {r.name_key: (r.action, r.minor, r.status) for r in first.collect()} == {
        "term": ("version", 1, "verified"), "cap": ("unchanged", 2, "draft"), "left": ("absent", 1, "draft"), "fresh": ("created", 0, "draft")}
    second = V.merge_columns(first.select(*stored.columns), batch)
    assert {r.action for r in second.collect()} == {"unchanged", "absent"}
    assert {(r.name_key, r.minor) for r in first.collect()} == {(r.name_key, r.minor) for r in second.collect()}


def test_next_version(spark):
    bumps = ["minor", "minor", "major", "minor", "major"]
    rows = [(1, i, b) for i, b in enumerate(bumps)]
    got = [r.version for r in V.next_version(spark.createDataFrame(rows, "column_id long, change_no long, bump string")).orderBy("change_no").collect()]
    assert got == ["v1.0", "v1.1", "v2.0", "v2.1", "v3.0"]


def test_changes_match_applying_them_one_by_one(spark):
    rnd = random.Random(3)
    fields = ["name", "status", "role", "concept", "native_type"]
    columns = {c: {"name": f"C{c}", "status": "draft", "role": None, "concept": None, "native_type": "Date", "text": "t0"} for c in range(6)}
    events = []
    for no in range(60):
        e = {f: rnd.choice([None, None, None, f"{f}{rnd.randrange(3)}"]) for f in fields}
        if rnd.random() < 0.1:
            e["status"] = "retired"
        e["text"] = rnd.choice([None, "t0", "t1", "t2"])
        events.append((rnd.randrange(6), no, *[e[f] for f in fields], e["text"], "minor", None))
    got, versions, log = V.apply_changes(
        spark.createDataFrame([(c, *[v[f] for f in [*fields, "text"]]) for c, v in columns.items()], COLUMN), spark.createDataFrame(events, EVENT))
    want_versions, want_log = set(), []
    for c, no, *rest in events:
        state = columns[c]
        values = dict(zip([*fields, "text"], rest))
        new_text = values["text"] is not None and values["text"] != state["text"]
        meta = any(values[f] is not None for f in fields)
        state.update({k: v for k, v in values.items() if v is not None})
        if values["name"] is not None:
            want_log.append((c, no, "rename"))
        if new_text:
            want_versions.add((c, no))
            want_log.append((c, no, "version"))
        elif meta:
            want_log.append((c, no, "retire" if values["status"] == "retired" else "revise"))
    assert {r.column_id: r.asDict() for r in got.collect()} == {c: {"column_id": c, **v} for c, v in columns.items()}
    assert {(r.column_id, r.change_no) for r in versions.collect()} == want_versions
    assert sorted((r.column_id, r.change_no, r.action) for r in log.collect()) == sorted(want_log)


def test_carry_forward(spark):
    rows = [("firm", 0, 1, "a|b", "YYYY", None, "x", None), ("firm", 0, 2, None, None, None, None, "Title"), ("matter", 5, 1, "c", "MM", "$1", None, None)]
    carried = V.standard_carry_forward(spark.createDataFrame(rows, "scope string, matter_id long, version long, vocabulary string, date_pattern string, currency_pattern string, evidence_boundary string, naming_rules string"))
    e = V.effective_standard(spark.createDataFrame([(5,)], "matter_id long"), carried).first()
    assert (e.vocabulary, e.date_pattern, e.currency_pattern, e.naming_rules, e.overridden) == ("a|b", "YYYY", "$1", "Title", ["vocabulary", "date_pattern"])
