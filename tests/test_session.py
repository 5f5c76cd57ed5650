"""What the driver has to hold stays small: broadcasts are bounded, findings are written family by family."""

from specaudit.operators import relational as R
from specaudit.operators.findings import FINDING
from specaudit.plans import all_builders, linting
from specaudit.session import bound_broadcasts
from specaudit.sources.views import Model

KEY = "spark.sql.autoBroadcastJoinThreshold"
FOLDER = "/root/testdata/sf0.001"


def test_queries_bound_broadcasts_and_keep_smaller_bounds(spark):
    before = spark.conf.get(KEY)
    try:
        for given, want in (("10485760", "1048576"), ("10m", "1048576"), ("256k", "256k"), ("-1", "-1")):
            spark.conf.set(KEY, given)
            bound_broadcasts(spark)
            assert spark.conf.get(KEY) == want
        spark.conf.set(KEY, "10485760")
        all_builders()["lint_length"](spark, FOLDER)
        assert spark.conf.get(KEY) == "1048576"
    finally:
        spark.conf.set(KEY, before)


def test_lint_prompts_reads_the_documents_once(spark, monkeypatch):
    written = []
    cut = linting.cut
    monkeypatch.setattr(linting, "cut", lambda df: written.append(df.columns) or cut(df))
    out = all_builders()["lint_prompts"](spark, FOLDER)
    assert not [f for f in out.inputFiles() if "documents.parquet" in f]
    assert sum("text" in columns for columns in written) == 1


def test_findings_are_written_family_by_family(spark, monkeypatch):
    all_builders()  # marts combines queries of the other modules
    from specaudit.plans import marts

    written, read = [], []
    monkeypatch.setattr(marts, "cut", lambda df: written.append(df.columns) or df)
    monkeypatch.setattr(marts, "shared", lambda m: None)
    monkeypatch.setattr(marts.registry, "result", lambda name, m: read.append(name) or spark.range(1).selectExpr(
        "id AS matter_id", "'x' AS code", *[f"id AS {k}" for k in sorted({f[4] for f in marts.FAMILIES} - {"matter_id"})]))
    marts.findings(Model(spark, FOLDER))
    assert len(read) == len(marts.FAMILIES) and written == [FINDING] * len(marts.FAMILIES)


def test_the_feed_joins_names_to_its_page_only(spark):
    events = spark.range(500).selectExpr("id AS event_id", "'login' AS entity_type", "id % 3 AS entity_id", "timestamp_seconds(id div 4) AS at")
    names = spark.createDataFrame([("login", 0, "a"), ("login", 1, "b")], "entity_type string, entity_id long, entity_name string")
    feed = R.activity_feed(events, names, 50, 10)
    assert [(r.event_id, r.entity_name, r.total, r.truncated) for r in feed.collect()] == [(i, "ab"[i % 3] if i % 3 < 2 else None, 500, True) for i in range(489, 439, -1)]
    plan = feed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Limit")  # the limit is below the join
