"""Queries over the evaluation log."""

from pyspark.sql import functions as F

from specaudit import vocab
from specaudit.functions import normalise as N
from specaudit.operators import evals as E
from specaudit.operators import relational as R
from specaudit.plans.registry import query
from specaudit.sources.views import SQL_VIEWS

_aliases = ", ".join(f"('{k}', '{v}')" for k, v in vocab.failure_class_aliases().items())
_classes = ", ".join(f"'{k}'" for k in vocab.FAILURE_CLASSES)
_dims = ", ".join(f"('{k}', {str(g).upper()})" for k, g in vocab.COVERAGE_DIMENSIONS)

# Plain-SQL fragments shared by the equivalents below. They only restate the model in SQL; the
# Spark side never reads them.
SQL_VIEWS["s_eval"] = f"""
SELECT e.*, CASE WHEN trim(raw_class) <> '' THEN coalesce(al.v, replace(replace(replace(lower(trim(raw_class)), '/', '_'), '-', '_'), ' ', '_')) END AS failure_class,
       lower(trim(raw_error_type)) AS error_type
FROM {{a_eval}} e LEFT JOIN (VALUES {_aliases}) al(k, v) ON al.k = lower(trim(raw_class))"""
SQL_VIEWS["s_latest"] = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY column_id, document
  ORDER BY started_at DESC, run_id DESC, result_id DESC, result_seq DESC) AS rn FROM {s_eval}) WHERE rn = 1"""
SQL_VIEWS["s_snapshot"] = """
SELECT r.run_id, r.table_id, c.column_id, r.started_at, v.prompt_version_id, i.instructions_version_id
FROM {a_run} r JOIN {a_column} c ON c.table_id = r.table_id AND c.status <> 'retired'
JOIN (SELECT *, lead(created_at) OVER (PARTITION BY column_id ORDER BY minor) AS until FROM {a_prompt_version}) v
  ON v.column_id = c.column_id AND v.created_at <= r.started_at AND (v.until IS NULL OR r.started_at < v.until)
LEFT JOIN (SELECT *, lead(created_at) OVER (PARTITION BY table_id ORDER BY version) AS until FROM {a_instructions}) i
  ON i.table_id = r.table_id AND i.created_at <= r.started_at AND (i.until IS NULL OR r.started_at < i.until)"""
SQL_VIEWS["s_pin"] = """
SELECT s.run_id, s.column_id, v.version FROM {s_snapshot} s JOIN {a_prompt_version} v USING (prompt_version_id)"""
SQL_VIEWS["s_pairs"] = """
SELECT table_id, max(run_id) FILTER (rn = 2) AS earlier, max(run_id) FILTER (rn = 1) AS later
FROM (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY started_at DESC, run_id DESC) AS rn FROM {a_run})
WHERE rn <= 2 GROUP BY 1 HAVING count(*) = 2"""
SQL_VIEWS["s_open"] = """
SELECT t.matter_id, t.table_id, c.column_id, l.failure_class, l.document FROM {s_latest} l
JOIN {a_column} c USING (column_id) JOIN {a_table} t USING (table_id)
WHERE NOT l.passed AND c.status <> 'retired'"""
SQL_VIEWS["s_last_in_run"] = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, column_id, document
  ORDER BY result_id DESC, result_seq DESC) AS rn FROM {s_eval}) WHERE rn = 1"""
SQL_VIEWS["s_outer"] = """
SELECT p.table_id, coalesce(a.column_id, b.column_id) AS column_id, coalesce(a.document, b.document) AS document,
       a.passed AS a_passed, b.passed AS b_passed, a.failure_class AS a_failure_class, b.failure_class AS b_failure_class
FROM (SELECT l.*, p.table_id FROM {s_last_in_run} l JOIN {s_pairs} p ON l.run_id = p.earlier) a
FULL JOIN (SELECT l.*, p.table_id FROM {s_last_in_run} l JOIN {s_pairs} p ON l.run_id = p.later) b
  ON a.column_id = b.column_id AND a.document = b.document AND a.table_id = b.table_id
JOIN {s_pairs} p ON p.table_id = coalesce(a.table_id, b.table_id)"""
SQL_VIEWS["s_compare"] = """
SELECT table_id, column_id, document, CASE WHEN a_passed IS NULL THEN 'only_in_later' WHEN b_passed IS NULL THEN 'only_in_earlier'
  WHEN NOT a_passed AND b_passed THEN 'fixed' WHEN NOT a_passed AND NOT b_passed THEN 'still_failing'
  WHEN a_passed AND NOT b_passed THEN 'newly_failing' ELSE 'still_passing' END AS bucket,
  a_failure_class, b_failure_class FROM {s_outer}"""
SQL_VIEWS["s_coverage"] = f"""
SELECT DISTINCT run_id, raw_dimension, replace(replace(lower(trim(raw_dimension)), '-', '_'), ' ', '_') AS value,
       d.k IS NOT NULL AS valid
FROM {{a_run_coverage}} LEFT JOIN (VALUES {_dims}) d(k, g)
  ON d.k = replace(replace(lower(trim(raw_dimension)), '-', '_'), ' ', '_')"""
SQL_VIEWS["s_latest_run"] = """
SELECT table_id, arg_max(run_id, (started_at, run_id)) AS run_id, max(started_at) AS started_at FROM {a_run} GROUP BY 1"""
SQL_VIEWS["s_unticked"] = f"""
SELECT r.table_id, d.k AS dimension, r.run_id FROM {{s_latest_run}} r JOIN {{a_table}} t USING (table_id)
CROSS JOIN (VALUES {_dims}) d(k, g)
WHERE (NOT d.g OR t.grouping_enabled)
  AND NOT EXISTS (SELECT 1 FROM {{s_coverage}} v WHERE v.run_id = r.run_id AND v.value = d.k)"""


def day(name: str):
    return F.to_date(name).cast("string").alias(name)


def log(m):
    return E.normalise_log(m.a_eval)


def latest(m):
    return m.once("latest", lambda: E.latest_results(m.a_eval))


def failures(m):
    return E.open_failures(latest(m))


def vertices(m):
    return m.once("vertices", lambda: R.load_vertices(m.a_column, m.a_table))


def snapshots(m):
    return m.once("snapshots", lambda: E.run_snapshot_build(m.a_run, m.a_column, m.a_prompt_version, m.a_instructions))


def pins(m):
    return E.version_pin_join(snapshots(m), m.a_prompt_version)


def pairs(m):
    return E.two_latest_runs(m.a_run)


def compared(m):
    return E.run_compare(E.run_results_outer(m.a_eval, pairs(m)))


def coverage(m):
    return N.normalise_dimension(m.a_run_coverage, "raw_dimension")


def unticked(m):
    return E.unticked_dimensions(m.a_table, m.a_run, coverage(m))


@query("normalise_failure_class", f"""
SELECT run_id, result_id, result_seq, failure_class AS value, failure_class IN ({_classes}) AS valid FROM s_eval""")
def _(m):
    return N.normalise_failure_class(m.a_eval, "raw_class").select("run_id", "result_id", "result_seq", "value", "valid")


@query("normalise_dimension", f"""
SELECT c.run_id, c.raw_dimension, c.value, c.valid,
       CASE WHEN NOT c.valid THEN 'COVERAGE_DIMENSION_UNKNOWN' WHEN c.value = 'grouped' AND NOT t.grouping_enabled
            THEN 'COVERAGE_DIMENSION_NOT_APPLICABLE' END AS code
FROM s_coverage c JOIN a_run r USING (run_id) JOIN a_table t USING (table_id)""")
def _(m):
    bad = E.inapplicable_dimensions(coverage(m), m.a_run, m.a_table)
    return coverage(m).join(
        bad.select("run_id", F.col("dimension").alias("raw_dimension"), "code"), ["run_id", "raw_dimension"], "left"
    )


_result = "column_id, document, run_id, passed, failure_class, error_type"


@query("latest_results", f"SELECT {_result} FROM s_latest")
def _(m):
    return latest(m).select("column_id", "document", "run_id", "passed", "failure_class", "error_type")


@query("open_failures", f"SELECT {_result} FROM s_latest WHERE NOT passed")
def _(m):
    return failures(m).select("column_id", "document", "run_id", "passed", "failure_class", "error_type")


@query("last_result_in_run", f"SELECT {_result} FROM s_last_in_run")
def _(m):
    return E.last_result_in_run(m.a_eval).select("column_id", "document", "run_id", "passed", "failure_class", "error_type")


@query("latest_run_per_table", "SELECT table_id, run_id, CAST(CAST(started_at AS DATE) AS VARCHAR) AS started_at FROM s_latest_run")
def _(m):
    return E.latest_run_per_table(m.a_run).select("table_id", "run_id", day("started_at"))


@query("last_run_per_column", """
SELECT column_id, run_id, CAST(CAST(started_at AS DATE) AS VARCHAR) AS started_at, prompt_version_id, instructions_version_id
FROM (SELECT *, row_number() OVER (PARTITION BY column_id ORDER BY started_at DESC, run_id DESC) AS rn FROM s_snapshot) WHERE rn = 1""")
def _(m):
    return E.last_run_per_column(snapshots(m)).select(
        "column_id", "run_id", day("started_at"), "prompt_version_id", "instructions_version_id"
    )


@query("two_latest_runs", "SELECT table_id, earlier, later FROM s_pairs")
def _(m):
    return pairs(m)


@query("run_snapshot_build", "SELECT run_id, column_id, prompt_version_id, instructions_version_id FROM s_snapshot")
def _(m):
    return snapshots(m).select("run_id", "column_id", "prompt_version_id", "instructions_version_id")


@query("version_pin_join", "SELECT run_id, column_id, version FROM s_pin")
def _(m):
    return pins(m)


@query("eval_version_default", """
SELECT e.run_id, e.column_id, e.result_id, e.result_seq, coalesce(e.cited_version, p.version) AS effective_version
FROM a_eval e LEFT JOIN s_pin p USING (run_id, column_id)""")
def _(m):
    return E.eval_version_default(m.a_eval, pins(m)).select("run_id", "column_id", "result_id", "result_seq", "effective_version")


@query("validate_eval", f"""
SELECT run_id, column_id, document, result_id, result_seq, code FROM (
  SELECT e.*, unnest([
    CASE WHEN p.version IS NULL THEN 'RUN_COLUMN_NOT_IN_SNAPSHOT' END,
    CASE WHEN lower(trim(e.cited_version)) <> lower(p.version) THEN 'PROMPT_VERSION_MISMATCH' END,
    CASE WHEN e.failure_class NOT IN ({_classes}) THEN 'FAILURE_CLASS_INVALID' END,
    CASE WHEN e.error_type NOT IN ('substantive', 'evidentiary', 'formatting') THEN 'ERROR_TYPE_INVALID' END,
    CASE WHEN e.passed AND (e.failure_class IS NOT NULL OR e.error_type IS NOT NULL) THEN 'FAILURE_FIELDS_ON_PASS' END,
    CASE WHEN NOT e.passed AND e.failure_class IS NULL THEN 'FAILURE_CLASS_MISSING' END]) AS code
  FROM s_eval e LEFT JOIN s_pin p USING (run_id, column_id)) WHERE code IS NOT NULL""")
def _(m):
    return E.validate_eval(log(m), pins(m))


@query("batch_pass_fail", """
SELECT run_id, count(*) AS stored, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed FROM a_eval GROUP BY 1""")
def _(m):
    return E.batch_pass_fail(m.a_eval)


@query("column_eval_summary", """
SELECT c.column_id, coalesce(r.runs, 0) AS runs, r.last_run_id, coalesce(t.n, 0) AS documents_tested,
       coalesce(t.f, 0) AS open_failures, coalesce(t.classes, '') AS open_classes
FROM a_column c
LEFT JOIN (SELECT column_id, count(*) AS runs, arg_max(run_id, (started_at, run_id)) AS last_run_id FROM s_snapshot GROUP BY 1) r USING (column_id)
LEFT JOIN (SELECT column_id, count(*) AS n, count(*) FILTER (NOT passed) AS f,
                  string_agg(DISTINCT failure_class, '|' ORDER BY failure_class) FILTER (NOT passed) AS classes FROM s_latest GROUP BY 1) t USING (column_id)""")
def _(m):
    return E.column_eval_summary(m.a_column, snapshots(m), latest(m)).withColumn(
        "open_classes", F.coalesce(F.array_join("open_classes", "|"), F.lit(""))
    )


@query("failures_summary", """
WITH o AS (SELECT *, coalesce(failure_class, '(unclassified)') AS ck FROM s_open)
SELECT matter_id, 'class' AS grouping_name, ck AS key, count(*) AS failures, count(DISTINCT table_id) AS tables,
       count(DISTINCT column_id) AS columns, count(DISTINCT failure_class) AS classes FROM o GROUP BY matter_id, ck
UNION ALL
SELECT matter_id, 'table', CAST(table_id AS VARCHAR), count(*), count(DISTINCT table_id), count(DISTINCT column_id), count(DISTINCT failure_class)
FROM o GROUP BY matter_id, table_id
UNION ALL
SELECT matter_id, 'column', CAST(column_id AS VARCHAR), count(*), count(DISTINCT table_id), count(DISTINCT column_id), count(DISTINCT failure_class)
FROM o GROUP BY matter_id, column_id""")
def failures_summary(m):
    return E.failures_summary(failures(m), vertices(m))


@query("recurring_failures", """
SELECT matter_id, failure_class, count(DISTINCT column_id) AS columns, count(DISTINCT table_id) AS tables FROM s_open
WHERE failure_class IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT column_id) >= 3 OR count(DISTINCT table_id) >= 2""")
def _(m):
    return E.recurring_failures(failures(m), vertices(m))


@query("run_results_outer", "SELECT * FROM s_outer")
def _(m):
    return E.run_results_outer(m.a_eval, pairs(m))


@query("run_compare", "SELECT * FROM s_compare")
def _(m):
    return compared(m)


@query("regressions", """
SELECT c.table_id, c.column_id, string_agg(c.document, '|' ORDER BY c.document) AS documents,
       any_value(a.version) AS earlier_version, any_value(b.version) AS later_version
FROM s_compare c JOIN s_pairs p USING (table_id)
LEFT JOIN s_pin a ON a.run_id = p.earlier AND a.column_id = c.column_id
LEFT JOIN s_pin b ON b.run_id = p.later AND b.column_id = c.column_id
WHERE c.bucket = 'newly_failing' GROUP BY 1, 2""")
def _(m):
    return E.regressions(compared(m), pairs(m), pins(m)).withColumn("documents", F.array_join("documents", "|"))


@query("unticked_dimensions", "SELECT table_id, dimension, run_id FROM s_unticked")
def _(m):
    return unticked(m)


@query("dimension_gaps", """
SELECT t.matter_id, u.table_id, u.run_id, string_agg(u.dimension, '|' ORDER BY u.dimension) AS unticked,
       CASE WHEN t.grouping_enabled THEN 14 ELSE 13 END AS applicable,
       u.table_id IN (SELECT c.table_id FROM a_column c JOIN a_assertion_source s USING (column_id)) AS sources_assertion
FROM s_unticked u JOIN a_table t USING (table_id) GROUP BY 1, 2, 3, 5""")
def _(m):
    return E.dimension_gaps(unticked(m), m.a_table, m.a_column, m.a_assertion_source).withColumn(
        "unticked", F.array_join("unticked", "|")
    )
