"""Queries: submissions, version histories, change events, standards, export and import."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specaudit import vocab
from specaudit.functions.normalise import norm_name
from specaudit.operators import coverage as C
from specaudit.operators import freshness as D
from specaudit.operators import versioning as V

from specaudit.plans.audits import current_prompts, current_rules, part_links, projects, snaps
from specaudit.plans.evaluation import log, snapshots, vertices
from specaudit.plans.graphs import reliability
from specaudit.plans.registry import query, sql
from specaudit.sources import export as X
from specaudit.sources.submissions import read_eval_log, read_submission
from specaudit.sources.views import SQL_VIEWS
from specaudit.session import new_folder

_types = ", ".join(f"('{k}', '{v}')" for k, v in vocab.NATIVE_TYPE_ALIASES.items())
_all_types = ", ".join(f"'{t}'" for t in vocab.NATIVE_TYPES)

_BATCH = """
SELECT CAST(FLOOR(p_partkey / 20) AS BIGINT) + 1 AS table_id, p_partkey AS seq, '  ' || p_name || '  ' || p_brand AS name,
       CAST(p_size % 20 AS INT) + 1 AS position, CASE p_type WHEN 'STANDARD' THEN 'classification' WHEN 'ECONOMY' THEN ' Text' WHEN 'MEDIUM' THEN 'DATE'
         WHEN 'PROMO' THEN 'Boolean' WHEN 'LARGE' THEN NULL ELSE 'Verbatim' END AS native_type,
       CASE WHEN p_size % 7 = 0 THEN 'Draft ' WHEN p_size % 7 = 1 THEN 'verified' WHEN p_size = 33 THEN 'archived' WHEN p_size = 13 THEN 'retired' END AS status,
       CASE WHEN p_size % 9 = 0 THEN 'Extraction' WHEN p_size = 44 THEN 'author' END AS role,
       CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 5 = 1 THEN 'Yes|No|yes ' WHEN p_size % 5 = 2 THEN 'Yes|' || p_brand ELSE NULL END AS options,
       CASE WHEN p_size % 2 = 0 THEN 'Return the ' || p_name || '.' ELSE d.text END AS prompt_text
FROM {part} LEFT JOIN {documents} d ON d.doc_id * 2 = p_partkey"""
SQL_VIEWS["s_batch"] = _BATCH
SQL_VIEWS["s_fold"] = f"""
SELECT table_id, seq, trim(regexp_replace(name, '\\s+', ' ', 'g')) AS name, position, coalesce(al.v, trim(native_type)) AS native_type, nullif(lower(trim(status)), '') AS status, nullif(lower(trim(role)), '') AS role,
  options, prompt_text, row_number() OVER (PARTITION BY table_id, lower(trim(regexp_replace(name, '\\s+', ' ', 'g'))) ORDER BY seq) AS rn
FROM {{s_batch}} LEFT JOIN (VALUES {_types}) al(k, v) ON al.k = lower(trim(native_type))"""
_bad_type = f"native_type IS NULL OR native_type NOT IN ({_all_types})"
_bad_label = "coalesce(status NOT IN ('draft', 'testing', 'verified', 'retired'), FALSE) OR coalesce(role NOT IN ('orientation', 'extraction', 'validation', 'reconciliation', 'human_review'), FALSE)"
SQL_VIEWS["s_accepted"] = f"SELECT * FROM {{s_fold}} WHERE NOT ({_bad_type}) AND NOT ({_bad_label}) AND rn = 1"
SQL_VIEWS["s_firsts"] = "SELECT table_id, position, min(seq) AS seq FROM {s_fold} GROUP BY 1, 2"
SQL_VIEWS["s_posdup"] = """
SELECT f.table_id, f.seq, f.position, f.name, h.name AS first_name FROM {s_fold} f JOIN {s_firsts} p ON p.table_id = f.table_id AND p.position = f.position
JOIN {s_fold} h ON h.seq = p.seq WHERE f.rn = 1 AND f.seq > p.seq"""
SQL_VIEWS["s_stored"] = """
SELECT c.table_id, c.column_id, c.name, c.position, c.native_type, c.status, c.role, v.text, v.minor FROM {a_column} c LEFT JOIN {a_prompt_version} v ON v.column_id = c.column_id AND v.is_current
WHERE c.column_id IN (SELECT min(column_id) FROM {a_column} GROUP BY table_id, lower(name))"""
SQL_VIEWS["s_merged"] = """
SELECT coalesce(b.table_id, s.table_id) AS table_id, lower(coalesce(b.name, s.name)) AS name_key, s.column_id, coalesce(b.name, s.name) AS name,
  CASE WHEN b.seq IS NOT NULL THEN b.position ELSE s.position END AS position, CASE WHEN b.seq IS NOT NULL THEN b.native_type ELSE s.native_type END AS native_type,
  CASE WHEN b.seq IS NOT NULL THEN coalesce(b.status, CASE WHEN s.status = 'retired' THEN 'draft' ELSE s.status END, 'draft') ELSE s.status END AS status, coalesce(b.role, s.role) AS role,
  CAST(CASE WHEN s.table_id IS NULL OR (b.seq IS NOT NULL AND s.minor IS NULL) THEN 0 WHEN b.seq IS NOT NULL AND s.text IS DISTINCT FROM b.prompt_text THEN s.minor + 1 ELSE s.minor END AS BIGINT) AS minor,
  CASE WHEN b.seq IS NULL THEN CASE WHEN s.status = 'retired' THEN 'retired' ELSE 'absent' END WHEN s.table_id IS NULL THEN 'created' WHEN s.text IS DISTINCT FROM b.prompt_text THEN 'version' ELSE 'unchanged' END AS action,
  CASE WHEN b.seq IS NOT NULL THEN b.prompt_text ELSE s.text END AS text
FROM {s_accepted} b FULL JOIN {s_stored} s ON s.table_id = b.table_id AND lower(s.name) = lower(b.name)"""


def batch(m):
    flat = m.spark.sql(_BATCH, part=m.part, documents=m.documents)
    return flat.withColumn("options", F.split("options", r"\|"))


def stored(m):
    first = m.a_column.groupBy("table_id", norm_name(F.col("name")).alias("k")).agg(F.min("column_id").alias("column_id")).select("column_id")
    text = current_prompts(m).select("column_id", "text", "minor")
    return m.a_column.join(first, "column_id", "left_semi").join(text, "column_id", "left").select(
        "table_id", "column_id", "name", "position", "native_type", "status", "role", "text", "minor")


def accepted(m):
    return V.validate_submission(batch(m))[0].select("table_id", "seq", "name", "position", "native_type", "status", "role", F.col("prompt_text").alias("text"))


@query("read_submission", "SELECT table_id, seq, name, position, native_type, status, role, coalesce(options, '') AS options, length(prompt_text) AS chars, FALSE AS corrupt FROM s_batch")
def _(m):
    path = new_folder(m.spark)
    batch(m).write.json(path)
    got = read_submission(m.spark, path)
    return got.select("table_id", "seq", "name", "position", "native_type", "status", "role", F.coalesce(F.array_join("options", "|"), F.lit("")).alias("options"),
                      F.length("prompt_text").cast("bigint").alias("chars"), F.col("_corrupt_record").isNotNull().alias("corrupt"))


@query("read_eval_log", """
SELECT run_id, column_id, document AS test_document, passed, cited_version AS prompt_version, CASE WHEN failure_class IS NOT NULL THEN failure_class END AS failure_class FROM s_eval""")
def _(m):
    path = new_folder(m.spark)
    names = ["run_id", "column_id", "test_document", "passed", "prompt_version", "actual_answer", "evidence_relied_on", "expected_behavior",
             "failure_class", "error_type", "revision_note", "rerun_scope", "result_after_rerun", "regressions"]
    row = log(m).withColumnsRenamed({"document": "test_document", "cited_version": "prompt_version"})
    blank = {n: F.lit(None).cast("string") for n in names if n not in row.columns}
    row.withColumns(blank).select(*names).write.option("header", "true").csv(path)
    return read_eval_log(m.spark, path).select("run_id", "column_id", "test_document", "passed", "prompt_version", "failure_class")


@query("name_duplicates", "SELECT table_id, seq, name FROM s_fold WHERE rn > 1")
def _(m):
    return V.name_duplicates(batch(m)).withColumn("name", F.trim(F.regexp_replace("name", r"\s+", " ")))


@query("position_duplicates", "SELECT table_id, seq, position, name, first_name FROM s_posdup")
def _(m):
    clean = batch(m).withColumn("name", F.trim(F.regexp_replace("name", r"\s+", " ")))
    return V.position_duplicates(clean)


@query("validate_submission", f"""
WITH o AS (SELECT *, list_transform(string_split(options, '|'), lambda x: trim(x)) AS opts FROM s_fold)
SELECT table_id, seq, name, code FROM (SELECT *, unnest([CASE WHEN native_type IS NULL THEN 'NATIVE_TYPE_MISSING' END, CASE WHEN native_type NOT IN ({_all_types}) THEN 'NATIVE_TYPE_INVALID' END,
  CASE WHEN native_type = 'Classify' AND options IS NULL THEN 'OPTIONS_MISSING' END,
  CASE WHEN native_type = 'Classify' AND (list_contains(opts, '') OR len(list_distinct(list_transform(opts, lambda x: lower(x)))) <> len(opts)) THEN 'OPTIONS_MALFORMED' END,
  CASE WHEN native_type IS DISTINCT FROM 'Classify' AND options IS NOT NULL THEN 'OPTIONS_ON_NON_CLASSIFY' END,
  CASE WHEN status NOT IN ('draft', 'testing', 'verified', 'retired') THEN 'STATUS_INVALID' END,
  CASE WHEN role NOT IN ('orientation', 'extraction', 'validation', 'reconciliation', 'human_review') THEN 'ROLE_INVALID' END,
  CASE WHEN rn > 1 THEN 'COLUMN_NAME_DUPLICATE' END]) AS code FROM o) WHERE code IS NOT NULL
UNION ALL SELECT table_id, seq, name, 'POSITION_DUPLICATE' FROM s_posdup""")
def _(m):
    return V.validate_submission(batch(m))[1]


@query("merge_columns", "SELECT table_id, name_key, column_id, name, position, native_type, status, role, minor, action FROM s_merged")
def _(m):
    return V.merge_columns(stored(m), accepted(m)).drop("text")


@query("merge_instructions", """
SELECT coalesce(s.table_id, b.table_id) AS table_id, CAST(coalesce(s.version, 0) + CASE WHEN b.table_id IS NOT NULL AND s.text IS DISTINCT FROM b.text THEN 1 ELSE 0 END AS BIGINT) AS version,
  length(CASE WHEN b.table_id IS NOT NULL THEN b.text ELSE s.text END) AS chars,
  CASE WHEN s.table_id IS NULL THEN 'created' WHEN b.table_id IS NULL THEN 'kept' WHEN s.text IS DISTINCT FROM b.text THEN 'version' ELSE 'unchanged' END AS action
FROM (SELECT table_id, version, text FROM a_instructions WHERE is_current) s
FULL JOIN (SELECT t.table_id, CASE WHEN t.grouping_enabled THEN coalesce(i.text, t.name) ELSE d.text END AS text FROM a_table t JOIN (SELECT doc_id % (SELECT count(*) FROM a_table) + 1 AS table_id, arg_max(text, doc_id) AS text FROM documents GROUP BY 1) d ON d.table_id = t.table_id LEFT JOIN a_instructions i ON i.table_id = t.table_id AND i.is_current) b USING (table_id)""")
def _(m):
    now = current_rules(m).select("table_id", "version", "text")
    tables = m.a_table.agg(F.count("*")).scalar()
    doc = m.documents.groupBy((F.col("doc_id") % tables + 1).alias("table_id")).agg(F.max_by("text", "doc_id").alias("d_text"))
    new = m.a_table.join(doc, "table_id").join(now.select("table_id", "text"), "table_id", "left").select(
        "table_id", F.when(F.col("grouping_enabled"), F.coalesce("text", "name")).otherwise(F.col("d_text")).alias("text"))
    return V.merge_instructions(now, new).select("table_id", "version", F.length("text").cast("bigint").alias("chars"), "action")


@query("next_version", """
WITH c AS (SELECT column_id, (run_id, result_id) AS change_no, run_id, result_id, CASE WHEN document = 'doc-7' THEN 'major' ELSE 'minor' END AS bump FROM a_eval WHERE raw_class IS NOT NULL),
d AS (SELECT column_id, change_no, run_id, result_id, max(bump) AS bump FROM c GROUP BY 1, 2, 3, 4),
n AS (SELECT *, sum(CASE WHEN rn = 1 OR bump = 'major' THEN 1 ELSE 0 END) OVER (PARTITION BY column_id ORDER BY change_no) AS major FROM (SELECT *, row_number() OVER (PARTITION BY column_id ORDER BY change_no) AS rn FROM d))
SELECT column_id, run_id, result_id, CAST(major AS BIGINT) AS major, minor, 'v' || CAST(major AS BIGINT) || '.' || minor AS version FROM (SELECT *, row_number() OVER (PARTITION BY column_id, major ORDER BY change_no) - 1 AS minor FROM n)""")
def _(m):
    changes = m.a_eval.where("raw_class is not null").select(
        "column_id", F.struct("run_id", "result_id").alias("change_no"),
        F.when(F.col("document") == "doc-7", "major").otherwise("minor").alias("bump"))
    numbered = V.next_version(changes.groupBy("column_id", "change_no").agg(F.max("bump").alias("bump")))
    return numbered.select("column_id", "change_no.run_id", "change_no.result_id", "major", "minor", "version")


def events(m):
    """Change events: each part line of an order sets some field of its column."""
    return m.a_eval.select(
        "column_id", F.struct("run_id", "result_id", "result_seq", "document").alias("change_no"),
        F.when(F.col("document") == "doc-1", F.concat(F.lit("Renamed "), F.col("column_id"))).alias("name"),
        F.when(F.col("document") == "doc-2", F.when(F.col("passed"), "verified").otherwise("retired")).alias("status"),
        F.when(F.col("document") == "doc-3", F.lit("extraction")).alias("role"),
        F.when(F.col("document") == "doc-4", F.lit("shared")).alias("concept"),
        F.when(F.col("document") == "doc-5", F.lit("Date")).alias("native_type"),
        F.when(F.col("document").isin("doc-6", "doc-7"), F.concat(F.lit("Text of "), F.col("run_id"))).alias("text"),
        F.when(F.col("passed"), "minor").otherwise("major").alias("bump"), F.col("raw_class").alias("note"))

@query("apply_changes", """
WITH e AS (SELECT column_id, row_number() OVER (PARTITION BY column_id ORDER BY run_id, result_id, result_seq, document) AS k, CASE WHEN document = 'doc-1' THEN 'Renamed ' || column_id END AS name,
    CASE WHEN document = 'doc-2' THEN CASE WHEN passed THEN 'verified' ELSE 'retired' END END AS status, CASE WHEN document = 'doc-3' THEN 'extraction' END AS role, CASE WHEN document = 'doc-4' THEN 'shared' END AS concept,
    CASE WHEN document = 'doc-5' THEN 'Date' END AS native_type, CASE WHEN document IN ('doc-6', 'doc-7') THEN 'Text of ' || run_id END AS text FROM a_eval),
t AS (SELECT *, lag(text) OVER (PARTITION BY column_id ORDER BY k) AS before FROM (SELECT column_id, k, text FROM e WHERE text IS NOT NULL
    UNION ALL SELECT column_id, 0, text FROM a_prompt_version WHERE is_current AND text IS NOT NULL AND column_id IN (SELECT column_id FROM a_column))),
v AS (SELECT column_id, k FROM t WHERE k > 0 AND before IS DISTINCT FROM text),
l AS (SELECT column_id, arg_max(name, k) FILTER (name IS NOT NULL) AS name, arg_max(status, k) FILTER (status IS NOT NULL) AS status, arg_max(role, k) FILTER (role IS NOT NULL) AS role,
    arg_max(native_type, k) FILTER (native_type IS NOT NULL) AS native_type FROM e GROUP BY 1),
w AS (SELECT e.column_id, count(*) FILTER (name IS NOT NULL) AS a, count(v.k) AS b, count(*) FILTER (v.k IS NULL AND coalesce(name, status, role, concept, native_type) IS NOT NULL AND status IS DISTINCT FROM 'retired') AS c,
    count(*) FILTER (v.k IS NULL AND status = 'retired') AS d FROM e LEFT JOIN v ON v.column_id = e.column_id AND v.k = e.k GROUP BY 1 HAVING a + b + c + d > 0)
SELECT x.column_id, coalesce(l.name, x.name) AS name, coalesce(l.status, x.status) AS status, coalesce(l.role, x.role) AS role, coalesce(l.native_type, x.native_type) AS native_type, nullif(w.b, 0) AS versions,
  w.a AS "rename", w.b AS version, w.c AS revise, w.d AS retire FROM a_column x LEFT JOIN l ON l.column_id = x.column_id LEFT JOIN w ON w.column_id = x.column_id""")
def _(m):
    cols = m.a_column.join(current_prompts(m).select("column_id", "text"), "column_id", "left")
    updated, versions, changes = V.apply_changes(cols, events(m))
    n = versions.groupBy("column_id").agg(F.count("*").alias("versions"))
    acts = changes.groupBy("column_id").agg(*[F.count_if(F.col("action") == a).alias(a) for a in ("rename", "version", "revise", "retire")])
    return updated.join(n, "column_id", "left").join(acts, "column_id", "left").select(
        "column_id", "name", "status", "role", "native_type", "versions", "rename", "version", "revise", "retire")


@query("stale_name_mentions", """
SELECT x.column_id, r.column_id AS renamed_id, r.name AS old_name, 'New ' || r.name AS new_name FROM (SELECT table_id, min(column_id) AS column_id, name FROM a_column WHERE status <> 'draft' GROUP BY table_id, name) r
JOIN (SELECT c.table_id, c.column_id, v.text FROM a_prompt_version v JOIN a_column c USING (column_id) WHERE v.is_current AND c.status <> 'retired') x
  ON x.table_id = r.table_id AND x.column_id <> r.column_id AND contains(lower(x.text), '@' || lower(r.name))""")
def _(m):
    renames = m.a_column.where("status <> 'draft'").groupBy("table_id", F.col("name").alias("old_name")).agg(F.min("column_id").alias("column_id")).withColumn(
        "new_name", F.concat(F.lit("New "), "old_name"))
    prompts = current_prompts(m).join(m.a_column.select("column_id", "table_id"), "column_id").select("table_id", "column_id", "text")
    return V.stale_name_mentions(renames, prompts, m.a_column)


_std = ["vocabulary", "date_pattern", "currency_pattern", "evidence_boundary", "naming_rules"]
SQL_VIEWS["s_carried"] = "SELECT scope, matter_id, version, " + ", ".join(
    f"last_value({f} IGNORE NULLS) OVER w AS {f}" for f in _std) + " FROM {a_standard} WINDOW w AS (PARTITION BY scope, matter_id ORDER BY version ROWS UNBOUNDED PRECEDING)"
SQL_VIEWS["s_stdnow"] = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scope, matter_id ORDER BY version DESC) AS rn FROM {s_carried}) WHERE rn = 1"
_list = "|".join(vocab.FALLBACK_VOCABULARY)


@query("standard_carry_forward", "SELECT * FROM s_carried")
def _(m):
    return V.standard_carry_forward(m.a_standard)


@query("effective_standard", f"""
SELECT m.matter_id, f.version AS firm_version, o.version AS matter_version, coalesce(f.vocabulary, '{_list}') AS vocabulary, coalesce(f.date_pattern, o.date_pattern) AS date_pattern,
  coalesce(f.currency_pattern, o.currency_pattern) AS currency_pattern, coalesce(f.evidence_boundary, o.evidence_boundary) AS evidence_boundary, coalesce(o.naming_rules, f.naming_rules) AS naming_rules,
  concat_ws('|', CASE WHEN o.vocabulary <> coalesce(f.vocabulary, '{_list}') THEN 'vocabulary' END, CASE WHEN o.date_pattern <> f.date_pattern THEN 'date_pattern' END,
    CASE WHEN o.currency_pattern <> f.currency_pattern THEN 'currency_pattern' END, CASE WHEN o.evidence_boundary <> f.evidence_boundary THEN 'evidence_boundary' END) AS overridden
FROM a_matter m CROSS JOIN (SELECT * FROM s_stdnow WHERE scope = 'firm') f LEFT JOIN (SELECT * FROM s_stdnow WHERE scope = 'matter') o ON o.matter_id = m.matter_id""")
def _(m):
    return V.effective_standard(m.a_matter, V.standard_carry_forward(m.a_standard)).withColumn("overridden", F.array_join("overridden", "|"))


@query("standard_conflicts", f"""
SELECT m.matter_id, 'STANDARD_CONTRADICTS_FIRM' AS code, x.field, x.firm_value, x.matter_value FROM (
  {" UNION ALL ".join(f"SELECT o.matter_id, '{f}' AS field, f.{f} AS firm_value, o.{f} AS matter_value FROM (SELECT * FROM s_stdnow WHERE scope = 'firm') f CROSS JOIN (SELECT * FROM s_stdnow WHERE scope = 'matter') o" for f in _std[:4])}) x
JOIN a_matter m USING (matter_id) WHERE firm_value <> matter_value
UNION ALL SELECT 0, 'STANDARD_VOCABULARY_NOT_SKILL', 'vocabulary', vocabulary, NULL FROM s_carried WHERE scope = 'firm' AND vocabulary <> '{_list}'""")
def _(m):
    return V.standard_conflicts(m.a_matter, V.standard_carry_forward(m.a_standard))


@query("outline_version", """
WITH k AS (SELECT matter_id, lower(table_name) AS tk, lower(name) AS ck, min(column_id) AS column_id FROM s_vertex GROUP BY 1, 2, 3),
s AS (SELECT a.matter_id, a.section, a.text AS assertion, a.kind, v.table_name, CASE WHEN v.status = 'retired' THEN v.name || ' old' ELSE v.name END AS column_name
  FROM a_assertion a LEFT JOIN a_assertion_source x USING (assertion_id) LEFT JOIN s_vertex v ON v.column_id = x.column_id)
SELECT DISTINCT s.matter_id, 2 AS version, s.section, s.assertion, s.kind, k.column_id, s.column_name IS NOT NULL AND k.column_id IS NULL AS missing
FROM s LEFT JOIN k ON k.matter_id = s.matter_id AND k.tk = lower(s.table_name) AND k.ck = lower(s.column_name)""")
def _(m):
    v = vertices(m).select("column_id", "table_name", F.when(F.col("status") == "retired", F.concat("name", F.lit(" old"))).otherwise(F.col("name")).alias("column_name"))
    named = m.a_assertion_source.join(v, "column_id").groupBy("assertion_id").agg(
        F.collect_list(F.struct(F.col("table_name").alias("table"), F.col("column_name").alias("column"))).alias("sources"))
    sent = m.a_assertion.join(named, "assertion_id", "left").select("matter_id", "section", F.col("text").alias("assertion"), "kind", "sources")
    outline, missing = C.outline_version(sent, m.a_matter.select("matter_id", F.lit(1).alias("version")), vertices(m))
    lost = missing.join(m.a_assertion.select("matter_id", "section", F.col("text").alias("assertion"), "kind"), ["matter_id", "section", "assertion"]).select(
        "matter_id", F.lit(2).alias("version"), "section", "assertion", "kind", F.lit(None).cast("bigint").alias("column_id"), F.lit(True).alias("missing")).distinct()
    return outline.withColumn("missing", F.lit(False)).unionByName(lost)


def export(m, **more):
    return X.build_export(
        m.a_table, m.a_column, m.a_prompt_version, m.a_run, log(m), m.a_dependency, m.a_parameter, bindings=m.a_binding, standards=m.a_standard,
        instructions=m.a_instructions, coverage=m.a_run_coverage.withColumnRenamed("raw_dimension", "dimension"), assertions=m.a_assertion,
        assertion_sources=m.a_assertion_source, requirements=m.a_requirement, requirement_parts=m.a_requirement_part, requirement_links=part_links(m), **more)


def whole_export(m):
    """All kinds, also those that `import_export` does not load."""
    standard = V.effective_standard(m.a_matter, V.standard_carry_forward(m.a_standard)).withColumn("overridden", F.array_join("overridden", "|"))
    return export(
        m, matters=m.a_matter, effective=standard, snapshots=snapshots(m), document_sets=snaps(m), run_document_sets=D.snapshot_asof(m.a_run, projects(m), snaps(m)),
        coverage_states=C.assertion_coverage(m.a_assertion, m.a_assertion_source, reliability(m)),
        events=m.a_event.where("entity_type <> 'error'").withColumn("entity_id", F.col("entity_id") + 1))


_when = "strftime({}, '%Y-%m-%d %H:%M:%S')".format
# Per kind of record: its matter, its fields in the order of the body, and where they come from.
_SENT = {
    "table": ("matter_id", ["name", "grouping_enabled", "project"], "a_table"),
    "column": ("t.matter_id", ["t.name", "c.name", "c.position", "native_type", "status", "role", "concept", "options"], "{columns} c JOIN a_table t USING (table_id)"),
    "version": ("v.matter_id", ["v.table_name", "v.name", "minor", "text", _when("created_at"), "is_current"], "a_prompt_version JOIN s_vertex v USING (column_id)"),
    "run": ("matter_id", ["name", "run_id", _when("started_at")], "a_run JOIN a_table USING (table_id)"),
    "result": ("v.matter_id", ["v.table_name", "v.name", "run_id", "document", "passed", "failure_class", "result_id", "result_seq"], "s_eval JOIN s_vertex v USING (column_id)"),
    "dependency": ("e.matter_id", ["a.table_name", "a.name", "b.table_name", "b.name", "e.kind"], "s_edge e JOIN s_vertex a ON a.column_id = e.src JOIN s_vertex b ON b.column_id = e.dst"),
    "parameter": ("p.matter_id", ["p.name", "value", "p.status", "v.table_name", "v.name"], "a_parameter p LEFT JOIN s_vertex v ON v.column_id = source_column_id"),
    "binding": ("p.matter_id", ["p.name", "t.name", "v.name", "site"], "a_binding b JOIN a_parameter p USING (parameter_id) JOIN a_table t USING (table_id) LEFT JOIN s_vertex v ON v.column_id = b.column_id"),
    "standard": ("matter_id", X.fields("standard"), "a_standard"),
    "instructions": ("matter_id", ["name", "version", "is_current", _when("created_at"), "text"], "a_instructions JOIN a_table USING (table_id)"),
    "coverage": ("matter_id", ["run_id", "raw_dimension"], "a_run_coverage JOIN a_run USING (run_id) JOIN a_table USING (table_id)"),
    "assertion": ("matter_id", X.fields("assertion"), "a_assertion"),
    "assertion_source": ("a.matter_id", ["section", "text", "v.table_name", "v.name"], "a_assertion a JOIN a_assertion_source USING (assertion_id) JOIN s_vertex v USING (column_id)"),
    "requirement": ("matter_id", X.fields("requirement"), "a_requirement"),
    "requirement_part": ("p.matter_id", ["source", "ref", "part_no", "label", "p.disposition", "p.reason"], "a_requirement_part p JOIN a_requirement USING (requirement_id)"),
    "requirement_link": ("r.matter_id", ["source", "ref", "part_no", "kind", "t.name", "l.section"], "s_part_link l JOIN a_requirement r USING (requirement_id) LEFT JOIN a_table t ON t.table_id = l.table_id"),
}

# What an export tells beside that: more fields of some kinds, and kinds that are not loaded again.
_TOLD = {k: (matter, told + {"table": ["position"], "result": ["error_type", "cited_version"], "dependency": ["e.parameter"], "parameter": [_when("resolved_at")]}.get(k, []), source)
         for k, (matter, told, source) in _SENT.items()} | {
    "matter": ("matter_id", X.fields("matter", X.EXPORTED), "a_matter"),
    "effective_standard": ("matter_id", X.fields("effective_standard", X.EXPORTED), "({effective}) x"),
    "snapshot": ("v.matter_id", ["s.run_id", "v.table_name", "v.name", "p.version", "i.version"], "s_snapshot s JOIN s_vertex v USING (column_id) JOIN a_prompt_version p USING (prompt_version_id) LEFT JOIN a_instructions i ON i.table_id = s.table_id AND i.instructions_version_id = s.instructions_version_id"),
    "document_set": ("u.matter_id", X.fields("document_set", X.EXPORTED), "s_snap JOIN (SELECT matter_id, project FROM a_matter UNION SELECT matter_id, project FROM a_table) u USING (project)"),
    "run_document_set": ("t.matter_id", ["x.run_id", "x.project", "x.snapshot_no"], "s_asof x JOIN a_table t USING (table_id)"),
    "coverage_state": ("a.matter_id", ["a.section", "a.text", "v.status", "v.sources", "v.has_retired_source"], "s_covered v JOIN a_assertion a USING (assertion_id)"),
    "event": ("r.matter_id", ["e.entity_type", "r.source", "r.ref", "e.action", "strftime(e.at, '%Y-%m-%d %H:%M:%S.%f')", "e.detail"], "a_event e JOIN a_requirement r ON r.requirement_id = e.entity_id + 1 AND e.entity_type <> 'error'"),
}


def _sent(columns: str, kinds: dict = _SENT) -> str:
    """A hash of every record, with `columns` as the table of columns."""
    def line(section, matter, told, source):
        values = ", ".join(f"coalesce(CAST({v} AS VARCHAR), '~')" for v in told)
        return f"SELECT {matter} AS matter_id, '{section}' AS section, CAST('0x' || substr(md5(concat_ws('|', {values})), 1, 8) AS BIGINT) AS h FROM {source.format(columns=columns, effective=sql('effective_standard'))}"

    return "\nUNION ALL ".join(line(section, *rest) for section, rest in kinds.items())


@query("build_export", f"SELECT matter_id, section, count(*) AS n, CAST(sum(h) AS BIGINT) AS digest FROM ({_sent('a_column', _TOLD)}) GROUP BY 1, 2")
def _(m):
    records = whole_export(m)
    kinds = [X.bodies(records, s, X.EXPORTED).groupBy("matter_id").agg(F.count("*").alias("n"), X.digest(s, X.EXPORTED)).withColumn("section", F.lit(s)) for s in X.EXPORTED]
    return reduce(DataFrame.unionByName, kinds)


# Of columns with one name in a table the first in order of the body is loaded.
_loaded = "(SELECT *, row_number() OVER (PARTITION BY table_id, lower(name) ORDER BY name, position NULLS FIRST) AS copy FROM a_column QUALIFY copy = 1)"


@query("import_export", f"""
SELECT section, count(*) AS n, CAST(sum(h) AS BIGINT) AS digest FROM ({_sent(_loaded)}) GROUP BY 1
UNION ALL SELECT 'dropped', count(*) - count(DISTINCT (table_id, lower(name))), NULL FROM a_column""")
def _(m):
    path = new_folder(m.spark)
    X.write_export(export(m), path)
    loaded, dropped = X.import_export(m.spark.read.schema("body string, format_version int, matter_id bigint, section string").json(path))
    parts = [df.agg(F.count("*").alias("n"), X.digest(s)).select(F.lit(s).alias("section"), "n", "digest") for s, df in loaded.items()]
    parts.append(dropped.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("dropped").alias("section"), "n", F.lit(None).cast("bigint").alias("digest")))
    return reduce(DataFrame.unionByName, parts)


@query("export_counts", """
SELECT m.matter_id, (SELECT count(*) FROM a_table x WHERE x.matter_id = m.matter_id) AS tables, (SELECT count(*) FROM s_vertex x WHERE x.matter_id = m.matter_id) AS columns,
  (SELECT count(*) FROM a_prompt_version p JOIN s_vertex x USING (column_id) WHERE x.matter_id = m.matter_id) AS prompt_versions, (SELECT count(*) FROM a_run r JOIN a_table x USING (table_id) WHERE x.matter_id = m.matter_id) AS runs,
  (SELECT count(*) FROM a_eval e JOIN s_vertex x USING (column_id) WHERE x.matter_id = m.matter_id) AS eval_results, (SELECT count(*) FROM a_parameter x WHERE x.matter_id = m.matter_id) AS parameters,
  (SELECT count(*) FROM s_edge x WHERE x.matter_id = m.matter_id) AS dependencies, (SELECT count(*) FROM a_assertion x WHERE x.matter_id = m.matter_id) AS assertions,
  (SELECT count(*) FROM a_requirement x WHERE x.matter_id = m.matter_id) AS requirements, (SELECT count(*) FROM a_standard x WHERE x.scope = 'matter' AND x.matter_id = m.matter_id) AS standards FROM a_matter m""")
def _(m):
    from specaudit.operators.marts import export_counts
    from specaudit.plans.relational import edges

    v = vertices(m).select("column_id", "matter_id")
    t = m.a_table.select("table_id", "matter_id")
    return export_counts({
        "tables": t, "columns": v, "prompt_versions": m.a_prompt_version.join(v, "column_id"), "runs": m.a_run.join(t, "table_id"),
        "eval_results": m.a_eval.join(v, "column_id"), "parameters": m.a_parameter, "dependencies": edges(m), "assertions": m.a_assertion,
        "requirements": m.a_requirement, "standards": m.a_standard.where("scope = 'matter'")})


@query("import_remap_provenance", """
SELECT e.event_id, e.entity_type, coalesce(c.c_custkey + 1000000, e.entity_id) AS entity_id, c.c_custkey IS NULL AS orphan FROM a_event e LEFT JOIN customer c ON c.c_custkey = e.entity_id AND c.c_acctbal > 0 AND e.entity_type <> 'error'""")
def _(m):
    kinds = m.a_event.select("entity_type").distinct().where("entity_type <> 'error'")
    known = m.a_event.select("entity_type", "entity_id").distinct().join(kinds, "entity_type", "left_semi")
    id_map = known.join(m.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("entity_id")), "entity_id", "left_semi").withColumn("new_id", F.col("entity_id") + 1000000)
    mapped, orphans = X.import_remap_provenance(m.a_event, id_map)
    cols = ["event_id", "entity_type", "entity_id"]
    return mapped.select(*cols, F.lit(False).alias("orphan")).unionByName(orphans.select(*cols, F.lit(True).alias("orphan")))
