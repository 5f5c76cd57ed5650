"""Queries: findings across audits, readiness, and wide summaries."""

from pyspark.sql import functions as F

from specaudit.operators import coverage as C
from specaudit.operators import evals as E
from specaudit.operators import findings as U
from specaudit.operators import marts as M
from specaudit.operators import relational as R
from specaudit.plans import audits, consistency, linting, relational, registry  # noqa: F401  (their queries are combined here)
from specaudit.plans.audits import current_prompts, fresh
from specaudit.plans.evaluation import failures, latest, snapshots, unticked, vertices
from specaudit.plans.graphs import reliability, states
from specaudit.plans.registry import query
from specaudit.plans.relational import edges, targets
from specaudit.session import cut
from specaudit.sources.views import SQL_VIEWS

# (query, family, code or None when the result carries one, subject, column that holds the subject)
FAMILIES = [
    ("prompt_findings", "prompts", None, "column", "column_id"),
    ("reference_findings", "graph", None, "column", "column_id"),
    ("cycle_components", "graph", "GRAPH_CYCLE", "column", "node"),
    ("dep_on_retired", "graph", "DEPENDENCY_ON_RETIRED", "column", "dst"),
    ("role_order", "graph", "ROLE_ORDER_VIOLATION", "column", "dst"),
    ("control_plane", "graph", "CONTROL_PLANE_NARRATIVE", "column", "column_id"),
    ("binding_dangling", "parameters", "BINDING_DANGLING", "column", "column_id"),
    ("param_orphaned", "parameters", "PARAM_ORPHANED", "parameter", "parameter_id"),
    ("param_source_retired", "parameters", "PARAM_SOURCE_RETIRED", "parameter", "parameter_id"),
    ("param_value_absent", "parameters", None, "table", "table_id"),
    ("param_not_in_instructions", "parameters", "PARAM_NOT_BOUND_TO_INSTRUCTIONS", "table", "table_id"),
    ("param_unresolved_consumed", "parameters", "PARAM_UNRESOLVED_CONSUMED", "table", "table_id"),
    ("instructions_missing", "consistency", "INSTRUCTIONS_MISSING", "table", "table_id"),
    ("instructions_vocabulary", "consistency", "INSTRUCTIONS_VOCABULARY_INCOMPLETE", "table", "table_id"),
    ("entity_name_variant", "consistency", "ENTITY_NAME_VARIANT", "matter", "matter_id"),
    ("date_divergence", "consistency", "DATE_PATTERN_DIVERGENT", "matter", "matter_id"),
    ("currency_divergence", "consistency", "CURRENCY_PATTERN_DIVERGENT", "matter", "matter_id"),
    ("standard_conflicts", "consistency", None, "matter", "matter_id"),
    ("concept_name_variant_tagged", "concepts", "CONCEPT_NAME_VARIANT", "matter", "matter_id"),
    ("concept_divergent_rules", "concepts", "CONCEPT_DIVERGENT_RULES", "matter", "matter_id"),
    ("unsourced_columns", "coverage", "COV_UNSOURCED_COLUMN", "column", "column_id"),
    ("coverage_findings", "coverage", None, "assertion", "assertion_id"),
    ("outline_missing", "coverage", "MEMO_OUTLINE_MISSING", "matter", "matter_id"),
    ("register_findings", "requirements", None, "requirement", "subject"),
    ("lifecycle_findings", "status", None, "column", "column_id"),
    ("open_failure_findings", "evaluation", None, "column", "column_id"),
    ("dimension_gaps", "coverage_dimensions", "COV_DIMENSION_UNTICKED", "table", "table_id"),
    ("freshness_findings", "document_set", None, "table", "table_id"),
    ("recurring_failures", "evaluation", "FAILURE_CLASS_RECURRING", "matter", "matter_id"),
    ("absent_from_ingest", "ingest", "COLUMN_ABSENT_FROM_INGEST", "column", "column_id"),
    ("assertions_at_risk", "staleness", "MEMO_ASSERTION_AT_RISK", "assertion", "assertion_id"),
    ("advisory_unresolved", "graph", "ADVISORY_REF_UNRESOLVED", "column", "column_id"),
]


@query("open_failure_findings", """
SELECT v.matter_id, v.table_id, l.column_id, l.document, l.run_id, coalesce(l.failure_class, 'unclassified') AS failure_class, 'OPEN_FAILURE' AS code
FROM s_latest l JOIN s_vertex v USING (column_id) WHERE NOT l.passed AND v.status <> 'retired'""")
def _(m):
    live = R.active_columns(vertices(m)).select("column_id", "table_id", "matter_id")
    return failures(m).join(live, "column_id").select(
        "matter_id", "table_id", "column_id", "document", "run_id", F.coalesce("failure_class", F.lit("unclassified")).alias("failure_class"),
        F.lit("OPEN_FAILURE").alias("code"))


@query("coverage_findings", """
SELECT matter_id, assertion_id, section, code FROM (SELECT *, unnest([CASE status WHEN 'judgment_boundary' THEN 'COV_JUDGMENT_BOUNDARY' WHEN 'extraction_gap' THEN 'COV_EXTRACTION_GAP' WHEN 'nominally_covered' THEN 'COV_NOMINAL_ONLY' END,
  CASE WHEN has_retired_source THEN 'COV_SOURCE_RETIRED' END]) AS code FROM s_covered) WHERE code IS NOT NULL""")
def _(m):
    return C.coverage_findings(C.assertion_coverage(m.a_assertion, m.a_assertion_source, reliability(m)))


@query("outline_missing", "SELECT matter_id, name FROM a_matter WHERE matter_id NOT IN (SELECT matter_id FROM a_assertion)")
def _(m):
    return m.a_matter.join(m.a_assertion, "matter_id", "left_anti").select("matter_id", "name")


MODEL = ("a_column", "a_prompt_version", "a_instructions", "a_run", "a_eval", "a_dependency", "a_binding", "a_assertion_source")


def shared(m):
    """What many families read is built once: the model's large tables, then what is derived from them."""
    for name in MODEL:
        m.keep(name, cut(getattr(m, name)))
    for name, build in (("vertices", vertices), ("edges", edges), ("latest", latest), ("snapshots", snapshots)):
        m.keep(name, cut(build(m)))


def findings(m):
    """Each family is written by itself, so that no plan, and no driver, holds what all of them join at once."""
    shared(m)
    place = {"column": vertices(m).select("column_id", "table_id", "matter_id"), "table": m.a_table.select("table_id", "matter_id")}
    return U.union_findings(*[
        cut(U.as_findings(registry.result(name, m), family, code, subject, key, place.get(subject)))
        for name, family, code, subject, key in FAMILIES
    ])


def _findings_sql() -> str:
    parts = []
    for name, family, code, subject, key in FAMILIES:
        where = {"column": "s_vertex", "table": "a_table"}.get(subject)
        place = f"JOIN {where} p ON p.{subject}_id = x.{key}" if where else ""
        parts.append(
            f"SELECT {'p' if where else 'x'}.matter_id, {'p.table_id' if where else 'CAST(NULL AS BIGINT)'} AS table_id, '{family}' AS family, {'x.code' if code is None else repr(code)} AS code, "
            f"'{subject}' AS subject_type, CAST(x.{key} AS VARCHAR) AS subject_id FROM ({registry.sql(name)}) x {place}")
    return " UNION ALL ".join(parts)


SQL_VIEWS["s_findings"] = registry.braced(_findings_sql())


@query("union_findings", "SELECT * FROM s_findings")
def _(m):
    return findings(m)


@query("finding_counts", "SELECT matter_id, family, code, count(*) AS n FROM s_findings GROUP BY 1, 2, 3")
def _(m):
    return U.finding_counts(findings(m))


@query("table_readiness", "SELECT matter_id, table_id, family AS cause, count(*) AS n FROM s_findings WHERE table_id IS NOT NULL GROUP BY 1, 2, 3")
def _(m):
    return U.table_readiness(findings(m))


@query("status_counts", """
SELECT table_id, count(*) FILTER (status = 'draft') AS draft, count(*) FILTER (status = 'testing') AS testing, count(*) FILTER (status = 'verified') AS verified, count(*) FILTER (status = 'retired') AS retired FROM a_column GROUP BY 1""")
def _(m):
    return M.status_counts(m.a_column)


@query("column_profile", """
SELECT v.column_id, v.table_id, v.matter_id, v.status, v.native_type, p.version, p.char_count, (SELECT count(DISTINCT src) FROM s_edge e WHERE e.dst = v.column_id) AS upstream, (SELECT count(DISTINCT dst) FROM s_edge e WHERE e.src = v.column_id) AS downstream,
  (SELECT count(DISTINCT parameter_id) FROM s_target t WHERE t.column_id = v.column_id) AS consumes, (SELECT count(*) FROM a_parameter q WHERE q.source_column_id = v.column_id) AS feeds, s.state,
  coalesce((SELECT count(*) FROM s_snapshot n WHERE n.column_id = v.column_id), 0) AS runs, coalesce((SELECT count(*) FROM s_latest l WHERE l.column_id = v.column_id AND NOT l.passed), 0) AS open_failures
FROM s_vertex v LEFT JOIN a_prompt_version p ON p.column_id = v.column_id AND p.is_current LEFT JOIN s_stale s ON s.column_id = v.column_id""")
def _(m):
    summary = E.column_eval_summary(m.a_column, snapshots(m), latest(m))
    return M.column_profile(vertices(m), current_prompts(m), edges(m), targets(m), m.a_parameter, states(m), summary)


@query("matter_overview", """
WITH t AS (SELECT t.matter_id, t.table_id, count(c.column_id) AS columns, count(*) FILTER (s.state = 'never_run') AS never_run, count(*) FILTER (s.state = 'current') AS current, count(*) FILTER (s.state = 'direct') AS direct,
    count(*) FILTER (s.state = 'transitive') AS transitive, coalesce(sum(f.n), 0) AS open_failures FROM a_table t LEFT JOIN a_column c ON c.table_id = t.table_id AND c.status <> 'retired' LEFT JOIN s_stale s ON s.column_id = c.column_id
  LEFT JOIN (SELECT column_id, count(*) AS n FROM s_latest WHERE NOT passed GROUP BY 1) f ON f.column_id = c.column_id GROUP BY 1, 2),
g AS (SELECT t.*, coalesce(u.n, 0) AS unticked, CASE WHEN d.state = 'moved' THEN 1 ELSE 0 END AS moved FROM t LEFT JOIN (SELECT table_id, count(*) AS n FROM s_unticked GROUP BY 1) u USING (table_id) LEFT JOIN s_fresh d USING (table_id))
SELECT matter_id, table_id, CAST(sum(columns) AS BIGINT) AS columns, CAST(sum(never_run) AS BIGINT) AS never_run, CAST(sum(current) AS BIGINT) AS current, CAST(sum(direct) AS BIGINT) AS direct, CAST(sum(transitive) AS BIGINT) AS transitive,
  CAST(sum(open_failures) AS BIGINT) AS open_failures, CAST(sum(unticked) AS BIGINT) AS unticked, CAST(sum(moved) AS BIGINT) AS moved FROM g GROUP BY GROUPING SETS ((matter_id, table_id), (matter_id))""")
def _(m):
    return M.matter_overview(m.a_table, m.a_column, states(m), failures(m), unticked(m), fresh(m))
