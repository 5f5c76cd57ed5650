"""Queries: normalisation, filters, joins, set operations and pages."""

from pyspark.sql import functions as F

from specaudit import vocab
from specaudit.functions import normalise as N
from specaudit.functions import text as T
from specaudit.operators import relational as R
from specaudit.plans.evaluation import day, failures, vertices
from specaudit.plans.registry import query
from specaudit.sources.views import SQL_VIEWS

_types = ", ".join(f"('{k}', '{v}')" for k, v in vocab.NATIVE_TYPE_ALIASES.items())
_vocab = ", ".join(f"'{v}'" for v in vocab.FALLBACK_VOCABULARY)

SQL_VIEWS["s_vertex"] = """
SELECT c.column_id, t.matter_id, c.table_id, coalesce(t.position, 0) AS table_position, t.name AS table_name,
       c.position, c.name, c.status, c.native_type, c.role
FROM {a_column} c JOIN {a_table} t USING (table_id)"""
SQL_VIEWS["s_target"] = """
SELECT DISTINCT b.parameter_id, c.column_id, b.site FROM {a_binding} b
JOIN {a_column} c ON c.column_id = b.column_id OR (b.column_id IS NULL AND c.table_id = b.table_id AND c.status <> 'retired')"""
SQL_VIEWS["s_edge"] = """
SELECT a.matter_id, d.src, d.dst, d.kind, p.name AS parameter FROM {a_dependency} d
JOIN {s_vertex} a ON a.column_id = d.src JOIN {s_vertex} b ON b.column_id = d.dst AND a.matter_id = b.matter_id
LEFT JOIN {a_parameter} p ON p.parameter_id = d.parameter_id"""
SQL_VIEWS["s_link"] = """
SELECT l.link_id, r.requirement_id, r.matter_id, lower(trim(l.kind)) AS kind, t.table_id FROM {a_requirement_link} l
JOIN {a_requirement} r USING (requirement_id)
LEFT JOIN {a_table} t ON lower(t.name) = lower(l.table_name) AND t.matter_id = r.matter_id"""
SQL_VIEWS["s_text"] = """
SELECT t.matter_id, t.table_id, CAST(NULL AS BIGINT) AS column_id, 'table_instructions' AS site, CAST(i.version AS VARCHAR) AS version, i.text
FROM {a_instructions} i JOIN {a_table} t USING (table_id) WHERE i.is_current
UNION ALL
SELECT v.matter_id, v.table_id, v.column_id, 'column_prompt', p.version, p.text
FROM {a_prompt_version} p JOIN {s_vertex} v USING (column_id) WHERE p.is_current AND v.status <> 'retired'"""


def targets(m):
    return R.binding_targets(m.a_binding, m.a_column)


def edges(m):
    return m.once("edges", lambda: R.load_edges(m.a_dependency, vertices(m), m.a_parameter))


def texts(m):
    """Current instructions and current prompts of active columns, with their place."""
    place = m.a_table.select("table_id", "matter_id")
    rules = R.current_versions(m.a_instructions).join(place, "table_id").select(
        "matter_id", "table_id", F.lit(None).cast("bigint").alias("column_id"),
        F.lit("table_instructions").alias("site"), F.col("version").cast("string").alias("version"), "text",
    )
    where = R.active_columns(vertices(m)).select("matter_id", "table_id", "column_id")
    prompts = R.current_versions(m.a_prompt_version).join(where, "column_id").select(
        "matter_id", "table_id", "column_id", F.lit("column_prompt").alias("site"), "version", "text"
    )
    return rules.unionByName(prompts)


def links(m):
    """Requirement links with folded kinds and their table resolved by name inside the matter."""
    req = m.a_requirement.select("requirement_id", "matter_id")
    t = m.a_table.select(N.norm_name(F.col("name")).alias("name_key"), "matter_id", "table_id")
    return (
        m.a_requirement_link.withColumns({"name_key": N.norm_name(F.col("table_name")), "kind": N.fold_label(F.col("kind"))})
        .join(req, "requirement_id").join(t, ["matter_id", "name_key"], "left")
    )


@query("norm_name", "SELECT conv_id, turn, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS name_key FROM conversations")
def _(m):
    return m.conversations.select("conv_id", "turn", N.norm_name(F.col("text")).alias("name_key"))


@query("fold_label", "SELECT DISTINCT disposition, lower(trim(disposition)) AS label FROM a_requirement")
def _(m):
    return m.a_requirement.select("disposition", N.fold_label(F.col("disposition")).alias("label")).distinct()


@query("normalise_native_type", f"""
SELECT p_partkey, coalesce(al.v, trim(x.raw)) AS value, coalesce(al.v, trim(x.raw)) IN ('Classify', 'Date', 'Currency', 'Number', 'Duration', 'Verbatim', 'FreeResponse') AS valid
FROM (SELECT p_partkey, CASE p_type WHEN 'STANDARD' THEN ' classification' WHEN 'ECONOMY' THEN 'Free Response' WHEN 'MEDIUM' THEN 'date'
  WHEN 'PROMO' THEN 'NUMERIC' WHEN 'LARGE' THEN 'Verbatim' ELSE p_type END AS raw FROM part) x
LEFT JOIN (VALUES {_types}) al(k, v) ON al.k = lower(trim(x.raw))""")
def _(m):
    raw = (
        F.when(F.col("p_type") == "STANDARD", " classification").when(F.col("p_type") == "ECONOMY", "Free Response")
        .when(F.col("p_type") == "MEDIUM", "date").when(F.col("p_type") == "PROMO", "NUMERIC")
        .when(F.col("p_type") == "LARGE", "Verbatim").otherwise(F.col("p_type"))
    )
    return N.normalise_native_type(m.part.select("p_partkey", raw.alias("raw")), "raw").select("p_partkey", "value", "valid")


@query("active_columns", "SELECT column_id, table_id, position FROM a_column WHERE status <> 'retired'")
def _(m):
    return R.active_columns(m.a_column).select("column_id", "table_id", "position")


@query("current_versions", "SELECT column_id, version, char_count FROM a_prompt_version WHERE is_current")
def _(m):
    return R.current_versions(m.a_prompt_version).select("column_id", "version", "char_count")


_found = "column_id, table_name, name, position, native_type, status, role"


@query("columns_find", f"""
WITH f AS (SELECT v.* FROM s_vertex v JOIN a_column c USING (column_id) WHERE v.status = 'verified' AND v.native_type IN ('Date')
  AND contains(lower(v.name), 'ring') AND v.column_id IN (SELECT column_id FROM s_target)
  AND v.column_id IN (SELECT column_id FROM s_open WHERE failure_class = 'scope_leakage'))
SELECT {_found}, (SELECT count(*) FROM f) AS total, (SELECT count(*) FROM f) > 20 AS truncated FROM f
ORDER BY table_position, table_name, position, column_id LIMIT 20""")
def _(m):
    failing = failures(m).where("failure_class = 'scope_leakage'")
    found = R.columns_find(
        vertices(m), status="verified", native_type="Date", name_contains="ring",
        consumed=targets(m), failing=failing, limit=20,
    )
    return found.select("column_id", "table_name", "name", "position", "native_type", "status", "role", "total", "truncated")


@query("column_history", """
SELECT column_id, version, CAST(CAST(created_at AS DATE) AS VARCHAR) AS created_at, is_current, char_count,
       char_count - lag(char_count) OVER (PARTITION BY column_id ORDER BY minor) AS char_delta FROM a_prompt_version""")
def _(m):
    return R.column_history(m.a_prompt_version).withColumn("created_at", F.to_date("created_at").cast("string"))




@query("activity_feed", """
SELECT e.event_id, e.entity_type, e.action, c.c_name AS entity_name, (SELECT count(*) FROM a_event) AS total, (SELECT count(*) FROM a_event) > 60 AS truncated
FROM a_event e LEFT JOIN customer c ON c.c_custkey = e.entity_id AND e.entity_type <> 'error' ORDER BY e.at DESC, e.event_id DESC LIMIT 50 OFFSET 10""")
def _(m):
    kinds = F.explode(F.array(*[F.lit(k) for k in ["click", "view", "purchase", "signup", "login", "logout", "search", "refund"]]))
    names = m.customer.select(kinds.alias("entity_type"), F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("entity_name"))
    feed = R.activity_feed(m.a_event, names, 50, 10)
    return feed.select("event_id", "entity_type", "action", "entity_name", "total", "truncated")


@query("page", """
SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total, (SELECT count(*) FROM orders) > 75 AS truncated
FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50""")
def _(m):
    return R.page(m.orders.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 25, 50)


@query("suite_order", """
SELECT column_id, coalesce(table_position, 0) AS table_position, table_name, position FROM s_vertex""")
def _(m):
    return R.suite_order(vertices(m)).select("column_id", "table_position", "table_name", "position")


@query("constraint_audit", f"""
SELECT 'dependency' AS table_name, 'kind in set' AS rule, CAST(src AS VARCHAR) AS key FROM a_dependency WHERE kind NOT IN ('intra_table_ref', 'cross_table_parameter', 'advisory')
UNION ALL SELECT 'binding', 'site in set', CAST(binding_id AS VARCHAR) FROM a_binding WHERE site NOT IN ('table_instructions', 'column_prompt')
UNION ALL SELECT 'assertion', 'kind in set', CAST(assertion_id AS VARCHAR) FROM a_assertion WHERE kind NOT IN ('extraction', 'judgment')
UNION ALL SELECT 'requirement', 'disposition in set', CAST(requirement_id AS VARCHAR) FROM a_requirement WHERE disposition NOT IN ('served', 'synthesis', 'external', 'unassessed')
UNION ALL SELECT 'requirement_link', 'kind in set', CAST(link_id AS VARCHAR) FROM a_requirement_link WHERE kind NOT IN ('served_by', 'consumes', 'produces')
UNION ALL SELECT 'matter', 'unique name', lower(name) FROM a_matter GROUP BY lower(name) HAVING count(*) > 1
UNION ALL SELECT 'column', 'unique table_id, name', CAST(table_id AS VARCHAR) || '/' || lower(name) FROM a_column GROUP BY table_id, lower(name) HAVING count(*) > 1
UNION ALL SELECT 'prompt_version', 'unique column_id, minor', CAST(column_id AS VARCHAR) || '/' || minor FROM a_prompt_version GROUP BY column_id, minor HAVING count(*) > 1
UNION ALL SELECT 'dependency', 'unique src, dst, kind', concat_ws('/', src, dst, kind) FROM a_dependency GROUP BY src, dst, kind HAVING count(*) > 1
UNION ALL SELECT 'binding', 'unique parameter_id, table_id, column_id, site', concat_ws('/', parameter_id, table_id, column_id, site) FROM a_binding GROUP BY parameter_id, table_id, column_id, site HAVING count(*) > 1""")
def _(m):
    return R.constraint_audit(
        m.a_matter, m.a_column, m.a_prompt_version, m.a_dependency, m.a_binding, m.a_assertion,
        m.a_requirement, m.a_requirement_link,
    )


@query("load_vertices", "SELECT column_id, matter_id, table_id, table_position, position, status, native_type, role FROM s_vertex")
def _(m):
    return vertices(m).drop("table_name", "name")


@query("load_edges", "SELECT * FROM s_edge")
def _(m):
    return edges(m)


@query("binding_targets", "SELECT * FROM s_target")
def _(m):
    return targets(m)


@query("consumes_parameter", "SELECT column_id, table_id FROM a_column WHERE column_id IN (SELECT column_id FROM s_target)")
def _(m):
    return R.consumes_parameter(m.a_column, targets(m)).select("column_id", "table_id")


@query("absent_from_ingest", """
SELECT c.table_id, c.column_id, c.name, c.status FROM a_column c WHERE c.status <> 'retired'
  AND c.table_id IN (SELECT table_id FROM a_column WHERE column_id IN (SELECT column_id FROM a_prompt_version WHERE is_current))
  AND NOT EXISTS (SELECT 1 FROM a_column b JOIN a_prompt_version v ON v.column_id = b.column_id AND v.is_current
                  WHERE b.table_id = c.table_id AND lower(b.name) = lower(c.name))""")
def _(m):
    batch = m.a_column.join(R.current_versions(m.a_prompt_version), "column_id", "left_semi")
    return R.absent_from_ingest(batch, m.a_column)


@query("unsourced_columns", """
SELECT column_id, table_id, native_type, role FROM a_column WHERE status <> 'retired' AND column_id NOT IN (SELECT column_id FROM a_assertion_source)""")
def _(m):
    return R.unsourced_columns(m.a_column, m.a_assertion_source).select("column_id", "table_id", "native_type", "role")


@query("tables_answering_nothing", "SELECT table_id, matter_id FROM a_table WHERE table_id NOT IN (SELECT table_id FROM s_link WHERE table_id IS NOT NULL)")
def _(m):
    return R.tables_answering_nothing(m.a_table, links(m)).select("table_id", "matter_id")


@query("text_sites", """
SELECT p.parameter_id, x.table_id, x.column_id, x.site, x.version,
  CAST((length(lower(x.text)) - length(replace(lower(x.text), lower(p.value), ''))) / length(p.value) AS BIGINT) AS occurrences,
  CASE WHEN x.column_id IS NULL THEN NOT EXISTS (SELECT 1 FROM a_binding b WHERE b.parameter_id = p.parameter_id AND b.table_id = x.table_id AND b.site = 'table_instructions')
       ELSE NOT EXISTS (SELECT 1 FROM a_binding b WHERE b.parameter_id = p.parameter_id AND b.column_id = x.column_id) END AS unbound
FROM s_text x JOIN a_parameter p ON p.matter_id = x.matter_id AND contains(lower(x.text), lower(p.value))""")
def _(m):
    return R.text_sites(m.a_parameter, texts(m), m.a_binding)


@query("unknown_members", """
SELECT DISTINCT r.matter_id, lower(l.table_name) AS name_key FROM a_requirement_link l JOIN a_requirement r USING (requirement_id)
WHERE NOT EXISTS (SELECT 1 FROM a_table t WHERE t.matter_id = r.matter_id AND lower(t.name) = lower(l.table_name))""")
def _(m):
    known = m.a_table.select("matter_id", N.norm_name(F.col("name")).alias("name_key"))
    return R.unknown_members(links(m), known, ["matter_id", "name_key"])


@query("fileset_diff", """
SELECT project, count(*) FILTER (NOT a) AS n_added, count(*) FILTER (NOT b) AS n_removed, count(*) FILTER (a AND b) AS n_kept FROM (
  SELECT project, file_id, bool_or(snapshot_no = 2) AS a, bool_or(snapshot_no = 4) AS b FROM a_docset_member WHERE snapshot_no IN (2, 4) GROUP BY 1, 2) GROUP BY 1""")
def _(m):
    member = m.a_docset_member
    return R.fileset_diff(member.where("snapshot_no = 2"), member.where("snapshot_no = 4"), "project", "file_id")


@query("vocabulary_missing", f"""
SELECT instructions_version_id, coalesce((SELECT string_agg(t, '|' ORDER BY i) FROM (SELECT unnest([{_vocab}]) AS t, unnest(range(5)) AS i) WHERE NOT contains(lower(text), lower(t))), '') AS missing
FROM a_instructions""")
def _(m):
    return m.a_instructions.select(
        "instructions_version_id", F.array_join(T.vocabulary_missing(F.col("text"), vocab.FALLBACK_VOCABULARY), "|").alias("missing")
    )


@query("token_jaccard", r"""
WITH t AS (SELECT doc_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) > 3)) AS k FROM documents)
SELECT a.doc_id, CASE WHEN len(a.k) > 0 AND len(b.k) > 0 THEN len(list_intersect(a.k, b.k)) / len(list_distinct(list_concat(a.k, b.k))) ELSE 0 END AS score
FROM t a JOIN t b ON b.doc_id = a.doc_id + 1""")
def _(m):
    tokens = m.documents.select("doc_id", T.content_tokens(F.col("text")).alias("k"))
    after = tokens.select((F.col("doc_id") - 1).alias("doc_id"), F.col("k").alias("k2"))
    return tokens.join(after, "doc_id").select("doc_id", T.token_jaccard(F.col("k"), F.col("k2")).alias("score"))


@query("token_containment", r"""
WITH t AS (SELECT doc_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) > 3)) AS k FROM documents)
SELECT a.doc_id, CASE WHEN len(a.k) > 0 THEN len(list_intersect(a.k, b.k)) / len(a.k) ELSE 0 END AS score
FROM t a JOIN t b ON b.doc_id = a.doc_id + 1""")
def _(m):
    tokens = m.documents.select("doc_id", T.content_tokens(F.col("text")).alias("k"))
    after = tokens.select((F.col("doc_id") - 1).alias("doc_id"), F.col("k").alias("k2"))
    return tokens.join(after, "doc_id").select("doc_id", T.token_containment(F.col("k"), F.col("k2")).alias("score"))
