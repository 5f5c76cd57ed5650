"""Nothing is cut: long ids, long names, many offending lines, short and long mentioned names, large pages."""

from pyspark.sql import functions as F

from specaudit.operators import consistency as C
from specaudit.operators import documents as D
from specaudit.operators import graph as G
from specaudit.operators import lint as L
from specaudit.operators import relational as R
from specaudit.operators import staleness as S
from specaudit.operators import versioning as V
from specaudit.operators.references import find_refs


def test_clusters_keep_long_matter_ids_apart(spark):
    links = spark.createDataFrame([(1234567890123, "a/x", "b"), (1234567890129, "b", "c")], "matter_id long, a string, b string")
    got = {(r.matter_id, r.name, r.cluster) for r in C.name_clusters(links).collect()}
    assert got == {(1234567890123, "a/x", "a/x"), (1234567890123, "b", "a/x"), (1234567890129, "b", "b"), (1234567890129, "c", "b")}


def test_references_resolve_to_long_names(spark):
    name = "Long " * 60 + "End"
    texts = spark.createDataFrame([(1, 1, f"See @{name}, then @{name}x and @Other Thing is")], "text_id long, table_id long, text string")
    names = spark.createDataFrame([(1, 5, name, 1)], "table_id long, column_id long, name string, position int")
    got = sorted((r.resolved_id or 0, r.raw) for r in find_refs(texts, names).collect())
    assert [g for g in got if g[0]] == [(5, name)] and len(got) == 3


def prompts(spark, text):
    row = spark.createDataFrame([(1, 2, 3, "n", 1, "Text", text)], "text_id long, column_id long, table_id long, name string, position int, native_type string, text string")
    return row.withColumn("options", F.lit(None).cast("array<string>"))


def test_every_offending_line_is_evidence(spark):
    text = "\n".join(f"Keep it under {100 + i} characters." for i in range(20)) + "\nReturn it."
    rows = L.lint_character_rule(prompts(spark, text)).collect()
    assert len(rows) == 1 and len(rows[0].evidence.split("|")) == 20
    both = {(r.code, r.evidence) for r in L.lint_row_rules(prompts(spark, text)).collect()}
    assert ("CHARACTER_COUNT_RULE", rows[0].evidence) in both


def test_mentions_of_short_and_long_names(spark):
    texts = spark.createDataFrame([(1, 1, 1, "the abc of overrule one"), (1, 1, 2, "ab"), (2, 1, 1, "abc")], "playbook_id long, edition int, position long, low string")
    names = spark.createDataFrame([(1, 1, n) for n in ("a", "abc", "rule one", "rule ones", "absent", "")], "playbook_id long, edition int, name_key string")
    got = {(r.playbook_id, r.position, r.name_key) for r in D.mentions(texts, names).collect()}
    assert got == {(1, 1, "a"), (1, 1, "abc"), (1, 1, "rule one"), (1, 2, "a")}


def test_page_honours_its_limit(spark):
    rows = R.page(spark.range(1500), [F.col("id")], 1200).collect()
    assert len(rows) == 1200 and rows[0].total == 1500 and rows[0].truncated


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 120)] + [(200, 200), (119, 90)]
    got = {r.node: (r.component, r.size) for r in G.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert all(got[i] == (0, 41) for i in range(41)) and all(got[i] == (90, 21) for i in (90, *range(100, 120))) and got[200] == (200, 1)


def test_staleness_names_its_causes(spark):
    states = spark.createDataFrame(
        [(1, "direct", ["prompt version changed"], 9, "2024-01-01"), (2, "transitive", ["x"], 9, "2024-01-01"), (3, "current", [], 9, "2024-01-01")],
        "column_id long, state string, reasons array<string>, run_id long, started_at string")
    edges = spark.createDataFrame([(1, 2, "advisory"), (3, 2, "advisory"), (1, 3, "advisory")], "src long, dst long, kind string")
    versions = spark.createDataFrame([(1, 11, "v1.1", "2023-01-01"), (3, 13, "v1.0", "2024-02-01")], "column_id long, prompt_version_id long, version string, created_at string")
    snapshots = spark.createDataFrame([(9, 1, 11)], "run_id long, column_id long, prompt_version_id long")
    got = {(r.column_id, r.reason, r.upstream_id, r.upstream_version) for r in S.staleness_reasons(states, edges, versions, snapshots).collect()}
    assert got == {(1, "prompt version changed", None, None), (2, "upstream stale", 1, "v1.1"), (2, "upstream changed", 3, "v1.0")}


def test_stale_names_are_found_wherever_they_stand(spark):
    renames = spark.createDataFrame([(1, 10, "Fee"), (1, 11, "Fee Cap"), (2, 12, "Fee")], "table_id long, column_id long, old_name string").withColumn("new_name", F.lit("New"))
    prompts = spark.createDataFrame([(1, 10, "own @Fee"), (1, 20, "x@@fee caps @F"), (1, 21, "Fee @ Fee"), (1, 22, "@FEE"), (3, 30, "@Fee"), (1, 23, "@Fee")], "table_id long, column_id long, text string")
    names = spark.createDataFrame([(c, "draft") for c in (10, 20, 21, 22, 30)] + [(23, "retired")], "column_id long, status string")
    got = {(r.column_id, r.renamed_id) for r in V.stale_name_mentions(renames, prompts, names).collect()}
    assert got == {(20, 10), (20, 11), (22, 10)}
