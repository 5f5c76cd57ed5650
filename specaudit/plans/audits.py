"""Queries: parameters, document sets, coverage and the requirement register."""

from pyspark.sql import functions as F

from specaudit.functions import normalise as N
from specaudit.operators import evals as E
from specaudit.operators import freshness as D
from specaudit.operators import parameters as P
from specaudit.operators import register as G
from specaudit.operators import relational as R
from specaudit.plans.evaluation import day
from specaudit.plans.registry import query
from specaudit.sources.views import SQL_VIEWS

_print = "CAST(sum(CAST(CAST('0x' || substr(sha256(file_id), 1, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR)"
SQL_VIEWS["s_snap"] = f"""
SELECT project, snapshot_no, observed_on, count(*) AS ready_count, max(CAST(uploaded_at AS DATE)) AS latest_upload, {_print} AS set_print
FROM {{a_docset_member}} GROUP BY 1, 2, 3"""
SQL_VIEWS["s_project"] = """
SELECT t.matter_id, t.table_id, coalesce(t.project, m.project) AS project FROM {a_table} t LEFT JOIN {a_matter} m USING (matter_id)"""
SQL_VIEWS["s_asof"] = """
SELECT run_id, table_id, project, snapshot_no FROM (
  SELECT r.run_id, r.table_id, p.project, s.snapshot_no, row_number() OVER (PARTITION BY r.run_id ORDER BY s.observed_on DESC, s.snapshot_no DESC) AS rn
  FROM {a_run} r JOIN {s_project} p USING (table_id) JOIN {s_snap} s ON s.project = p.project AND s.observed_on <= CAST(r.started_at AS DATE)) WHERE rn = 1"""
SQL_VIEWS["s_fresh"] = """
SELECT p.matter_id, p.table_id, p.project, r.run_id,
  CASE WHEN c.snapshot_no IS NULL THEN 'unobserved' WHEN r.run_id IS NULL THEN 'never_run' WHEN b.snapshot_no IS NULL THEN 'unrecorded'
       WHEN c.ready_count <> b.ready_count OR c.latest_upload > b.latest_upload OR c.set_print <> b.set_print THEN 'moved' ELSE 'current' END AS state,
  c.ready_count - b.ready_count AS ready_delta
FROM {s_project} p
LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY observed_on DESC, snapshot_no DESC) AS rn FROM {s_snap}) WHERE rn = 1) c USING (project)
LEFT JOIN {s_latest_run} r USING (table_id)
LEFT JOIN {s_asof} x ON x.run_id = r.run_id
LEFT JOIN {s_snap} b ON b.project = x.project AND b.snapshot_no = x.snapshot_no"""
SQL_VIEWS["s_req"] = """
SELECT requirement_id, matter_id, source, ref, title, CASE WHEN lower(trim(disposition)) IN ('served', 'synthesis', 'external', 'unassessed') THEN lower(trim(disposition)) ELSE 'unassessed' END AS disposition,
       CASE WHEN lower(trim(disposition)) NOT IN ('served', 'synthesis', 'external', 'unassessed') THEN lower(trim(disposition)) END AS invalid_disposition FROM {a_requirement}"""
SQL_VIEWS["s_judged"] = """
SELECT l.link_id, r.requirement_id, r.matter_id, lower(trim(l.kind)) AS kind, l.section, t.table_id, t.name AS table_name, r.ref,
  CASE WHEN lower(trim(l.kind)) NOT IN ('served_by', 'consumes', 'produces') THEN 'REQUIREMENT_LINK_INVALID'
       WHEN lower(trim(l.kind)) = 'produces' AND NOT EXISTS (SELECT 1 FROM {a_assertion} a WHERE a.matter_id = r.matter_id AND lower(a.section) = lower(l.section)) THEN 'REQUIREMENT_SECTION_MISSING'
       WHEN lower(trim(l.kind)) <> 'produces' AND t.table_id IS NULL THEN 'REQUIREMENT_TABLE_MISSING' END AS code
FROM {a_requirement_link} l JOIN {a_requirement} r USING (requirement_id)
LEFT JOIN {a_table} t ON t.matter_id = r.matter_id AND lower(t.name) = lower(l.table_name)"""
SQL_VIEWS["s_kept"] = """
SELECT matter_id, requirement_id, kind, CASE WHEN kind <> 'produces' THEN table_id END AS table_id,
       CASE WHEN kind = 'produces' THEN section END AS section, min(link_id) AS link_id FROM {s_judged} WHERE code IS NULL GROUP BY 1, 2, 3, 4, 5"""


def current_rules(m):
    return R.current_versions(m.a_instructions)


def current_prompts(m):
    return R.current_versions(m.a_prompt_version)


def snaps(m):
    return D.record_docset(m.a_docset_member)


def projects(m):
    return D.table_projects(m.a_table, m.a_matter)


def fresh(m):
    s = snaps(m)
    pinned = D.snapshot_asof(m.a_run, projects(m), s)
    return D.docset_freshness(projects(m), s, E.latest_run_per_table(m.a_run), pinned)


def requirements(m):
    return G.fold_disposition(m.a_requirement)


def resolved(m):
    return G.resolve_links(m.a_requirement_link, m.a_requirement, m.a_table, m.a_assertion)


@query("param_orphaned", "SELECT matter_id, parameter_id, status FROM a_parameter WHERE parameter_id NOT IN (SELECT parameter_id FROM a_binding)")
def _(m):
    return P.param_orphaned(m.a_parameter, m.a_binding)


@query("param_unresolved_consumed", """
SELECT p.matter_id, p.parameter_id, b.table_id, p.status, count(*) AS bindings FROM a_parameter p JOIN a_binding b USING (parameter_id) WHERE p.status <> 'resolved' GROUP BY ALL""")
def _(m):
    return P.param_unresolved_consumed(m.a_parameter, m.a_binding)


@query("param_source_retired", """
SELECT p.matter_id, p.parameter_id, p.source_column_id FROM a_parameter p JOIN a_column c ON c.column_id = p.source_column_id AND c.status = 'retired'""")
def _(m):
    return P.param_source_retired(m.a_parameter, m.a_column)


@query("binding_dangling", "SELECT binding_id, parameter_id, column_id FROM a_binding JOIN a_column c USING (column_id) WHERE c.status = 'retired'")
def _(m):
    return P.binding_dangling(m.a_binding, m.a_column)


@query("param_not_in_instructions", "SELECT parameter_id, table_id FROM a_binding GROUP BY 1, 2 HAVING NOT bool_or(site = 'table_instructions')")
def _(m):
    return P.param_not_in_instructions(m.a_binding)


@query("param_value_absent", """
SELECT b.binding_id, b.parameter_id, b.table_id, b.column_id, 'PARAM_VALUE_ABSENT_FROM_INSTRUCTIONS' AS code, CAST(i.version AS VARCHAR) AS version
FROM a_binding b JOIN a_parameter p ON p.parameter_id = b.parameter_id AND p.value <> '' LEFT JOIN a_instructions i ON i.table_id = b.table_id AND i.is_current
WHERE b.site = 'table_instructions' AND NOT coalesce(contains(lower(i.text), lower(p.value)), FALSE)
UNION ALL
SELECT b.binding_id, b.parameter_id, b.table_id, b.column_id, 'PARAM_VALUE_ABSENT_FROM_PROMPT', v.version
FROM a_binding b JOIN a_parameter p ON p.parameter_id = b.parameter_id AND p.value <> '' LEFT JOIN a_prompt_version v ON v.column_id = b.column_id AND v.is_current
WHERE b.site <> 'table_instructions' AND b.column_id IS NOT NULL AND NOT coalesce(contains(lower(v.text), lower(p.value)), FALSE)""")
def _(m):
    return P.param_value_absent(m.a_parameter, m.a_binding, current_rules(m), current_prompts(m))


@query("parameter_mart", """
SELECT p.parameter_id, p.matter_id, p.value, p.status, p.source_column_id, c.status AS source_status,
       (SELECT count(*) FROM a_binding b WHERE b.parameter_id = p.parameter_id) AS consumers, CAST(CAST(p.resolved_at AS DATE) AS VARCHAR) AS resolved_at
FROM a_parameter p LEFT JOIN a_column c ON c.column_id = p.source_column_id""")
def _(m):
    return P.parameter_mart(m.a_parameter, m.a_binding, m.a_column).withColumn("resolved_at", F.to_date("resolved_at").cast("string"))


@query("record_docset", "SELECT project, snapshot_no, CAST(observed_on AS VARCHAR) AS observed_on, ready_count, CAST(latest_upload AS VARCHAR) AS latest_upload, set_print FROM s_snap")
def _(m):
    return snaps(m).withColumns({c: F.col(c).cast("string") for c in ("observed_on", "latest_upload")})


@query("ready_file_inventory", f"""
WITH p AS (SELECT project, count(*) AS n, max(CAST(uploaded_at AS DATE)) AS u, {_print} AS fp FROM a_file WHERE processing_status = 'ready_to_query' AND deleted_on IS NULL GROUP BY 1)
SELECT p.project, l.complete, p.n AS documents, CASE WHEN l.complete THEN CAST(p.u AS VARCHAR) END AS latest_upload, CASE WHEN l.complete THEN p.fp END AS set_print
FROM p JOIN a_listing l USING (project)""")
def _(m):
    kept, rejected = D.ready_file_inventory(m.a_file, m.a_listing)
    a = kept.select("project", F.lit(True).alias("complete"), F.col("ready_count").alias("documents"), F.col("latest_upload").cast("string").alias("latest_upload"), "set_print")
    b = rejected.select("project", F.lit(False).alias("complete"), F.col("documents_seen").alias("documents"))
    return a.unionByName(b, allowMissingColumns=True)


@query("snapshot_diff", """
SELECT a.project, 1 AS before_no, 3 AS after_no, b.project IS NOT NULL AS comparable, a.ready_count - b.ready_count AS ready_delta, a.latest_upload > b.latest_upload AS later_upload,
       CASE WHEN b.project IS NOT NULL THEN 'set' END AS basis, a.ready_count <> b.ready_count OR a.latest_upload > b.latest_upload OR a.set_print <> b.set_print AS moved
FROM (SELECT * FROM s_snap WHERE snapshot_no = 3) a LEFT JOIN (SELECT * FROM s_snap WHERE snapshot_no = 1) b USING (project)""")
def _(m):
    pairs = snaps(m).where("snapshot_no = 3").select("project", F.lit(1).cast("bigint").alias("before_no"), F.lit(3).cast("bigint").alias("after_no"))
    return D.snapshot_diff(pairs, snaps(m))


@query("previous_snapshot_diff", """
WITH o AS (SELECT *, lag(snapshot_no) OVER w AS before_no, lag(ready_count) OVER w AS pc, lag(latest_upload) OVER w AS pu, lag(set_print) OVER w AS pp
           FROM s_snap WINDOW w AS (PARTITION BY project ORDER BY observed_on, snapshot_no))
SELECT o.project, o.snapshot_no, o.before_no, o.ready_count - o.pc AS ready_delta, o.latest_upload > o.pu AS later_upload, 'set' AS basis,
       o.ready_count <> o.pc OR o.latest_upload > o.pu OR o.set_print <> o.pp AS moved,
  (SELECT count(*) FROM a_docset_member n WHERE n.project = o.project AND n.snapshot_no = o.snapshot_no AND NOT EXISTS
     (SELECT 1 FROM a_docset_member p WHERE p.project = o.project AND p.snapshot_no = o.before_no AND p.file_id = n.file_id)) AS added,
  (SELECT count(*) FROM a_docset_member n WHERE n.project = o.project AND n.snapshot_no = o.before_no AND NOT EXISTS
     (SELECT 1 FROM a_docset_member p WHERE p.project = o.project AND p.snapshot_no = o.snapshot_no AND p.file_id = n.file_id)) AS removed
FROM o WHERE o.before_no IS NOT NULL""")
def _(m):
    return D.previous_snapshot_diff(snaps(m), m.a_docset_member)


@query("snapshot_asof", "SELECT * FROM s_asof")
def _(m):
    return D.snapshot_asof(m.a_run, projects(m), snaps(m))


@query("docset_freshness", "SELECT * FROM s_fresh")
def _(m):
    return fresh(m)


@query("freshness_findings", """
SELECT matter_id, table_id, project, CASE state WHEN 'moved' THEN 'DOCSET_MOVED' WHEN 'unrecorded' THEN 'DOCSET_UNRECORDED'
  ELSE CASE WHEN project IS NULL THEN 'DOCSET_NO_PROJECT' ELSE 'DOCSET_UNOBSERVED' END END AS code FROM s_fresh WHERE state IN ('moved', 'unrecorded', 'unobserved')""")
def _(m):
    return D.freshness_findings(fresh(m))


@query("docset_state_counts", "SELECT matter_id, state, count(*) AS n FROM s_fresh GROUP BY 1, 2")
def _(m):
    return D.docset_state_counts(fresh(m))


SQL_VIEWS["s_part"] = """
SELECT p.requirement_id, p.matter_id, p.part_no, nullif(trim(p.label), '') AS label, p.reason,
       CASE WHEN lower(trim(p.disposition)) IN ('served', 'synthesis', 'external', 'unassessed') THEN lower(trim(p.disposition)) ELSE 'unassessed' END AS disposition FROM {a_requirement_part} p"""
SQL_VIEWS["s_part_link"] = """
SELECT requirement_id, CAST(link_id % (1 + requirement_id % 3) + 1 AS INTEGER) AS part_no, kind, table_id, section FROM {s_kept}"""


def parts(m):
    return G.fold_disposition(m.a_requirement_part).withColumn("label", F.nullif(F.trim("label"), F.lit("")))


def part_links(m):
    return resolved(m)[0].withColumn("part_no", F.expr("cast(link_id % (1 + requirement_id % 3) + 1 as int)"))


@query("disposition_counts", """
SELECT matter_id, count(*) FILTER (disposition = 'served') AS served, count(*) FILTER (disposition = 'synthesis') AS synthesis, count(*) FILTER (disposition = 'external') AS external,
       count(*) FILTER (disposition = 'unassessed') AS unassessed, count(DISTINCT requirement_id) AS requirements FROM s_part GROUP BY 1""")
def _(m):
    return G.disposition_counts(parts(m))


@query("register_report", """
SELECT r.matter_id, r.source, r.requirement_id, r.ref, r.title, p.part_no, p.label, p.disposition, p.reason, l.kind, coalesce(t.name, l.section) AS target
FROM s_req r JOIN s_part p USING (requirement_id) LEFT JOIN s_part_link l ON l.requirement_id = p.requirement_id AND l.part_no = p.part_no LEFT JOIN a_table t ON t.table_id = l.table_id""")
def _(m):
    return G.register_report(requirements(m), parts(m), part_links(m), m.a_table)


@query("register_findings", """
SELECT matter_id, 'REQUIREMENT_SOURCE_MISSING' AS code, CAST(matter_id AS VARCHAR) AS subject, 'matter' AS scope FROM a_matter WHERE matter_id NOT IN (SELECT matter_id FROM s_req)
UNION ALL SELECT matter_id, 'REQUIREMENT_UNASSESSED', ref, 'requirement' FROM s_req WHERE disposition = 'unassessed'
UNION ALL SELECT matter_id, 'REQUIREMENT_EXTERNAL', ref, 'requirement' FROM s_req WHERE disposition = 'external'
UNION ALL SELECT matter_id, 'REQUIREMENT_SERVED_BY_NOTHING', ref, 'requirement' FROM s_req WHERE disposition = 'served' AND requirement_id NOT IN (SELECT requirement_id FROM s_kept WHERE kind = 'served_by')
UNION ALL SELECT matter_id, 'REQUIREMENT_DISPOSITION_INVALID', ref, 'requirement' FROM s_req WHERE invalid_disposition IS NOT NULL
UNION ALL SELECT matter_id, code, ref, 'requirement' FROM s_judged WHERE code IS NOT NULL
UNION ALL SELECT matter_id, 'TABLE_ANSWERS_NO_REQUIREMENT', CAST(table_id AS VARCHAR), 'table' FROM a_table WHERE matter_id IN (SELECT matter_id FROM s_req) AND table_id NOT IN (SELECT table_id FROM s_kept WHERE table_id IS NOT NULL)""")
def _(m):
    kept, dropped = resolved(m)
    return G.register_findings(m.a_matter, requirements(m), kept, dropped, m.a_table)


@query("register_merge", """
WITH s AS (SELECT matter_id, source, ref, title, disposition FROM a_requirement),
b AS (SELECT matter_id, source, ref || '-' || o.o_orderpriority AS ref, title, disposition FROM a_requirement r JOIN orders o ON o.o_custkey = r.requirement_id - 1 AND o.o_totalprice > 495000
      UNION SELECT matter_id, source, ref, 'Revised ' || title, 'served' FROM a_requirement WHERE reason IS NOT NULL)
SELECT coalesce(s.matter_id, b.matter_id) AS matter_id, coalesce(s.source, b.source) AS source, coalesce(s.ref, b.ref) AS ref, coalesce(b.title, s.title) AS title,
  CASE WHEN lower(trim(coalesce(b.disposition, s.disposition))) IN ('served', 'synthesis', 'external', 'unassessed') THEN lower(trim(coalesce(b.disposition, s.disposition))) ELSE 'unassessed' END AS disposition,
  CASE WHEN b.ref IS NULL THEN 'kept' WHEN s.ref IS NULL THEN 'created' ELSE 'updated' END AS action
FROM s FULL JOIN b ON s.matter_id = b.matter_id AND s.source = b.source AND s.ref = b.ref""")
def _(m):
    stored = m.a_requirement.select("matter_id", "source", "ref", "title", "disposition")
    big = m.orders.where("o_totalprice > 495000").select((F.col("o_custkey") + 1).alias("requirement_id"), "o_orderpriority")
    added = m.a_requirement.join(big, "requirement_id").select(
        "matter_id", "source", F.concat_ws("-", "ref", "o_orderpriority").alias("ref"), "title", "disposition")
    revised = m.a_requirement.where("reason is not null").select(
        "matter_id", "source", "ref", F.concat(F.lit("Revised "), "title").alias("title"), F.lit("served").alias("disposition"))
    merged, outcome, _missing = G.register_merge(stored, added.unionByName(revised).distinct())
    return merged.drop("invalid_disposition").join(outcome, ["matter_id", "source", "ref"])


# A batch that revises every requirement with a reason, those that are external twice, and adds some without parts.
_batch = """
WITH rev AS (SELECT requirement_id, matter_id, source, ref, CASE WHEN lower(trim(disposition)) = 'external' THEN 2 ELSE 1 END AS item_no FROM a_requirement WHERE reason IS NOT NULL),
added AS (SELECT DISTINCT r.matter_id, r.source, r.ref || '-' || o.o_orderpriority AS ref FROM a_requirement r JOIN orders o ON o.o_custkey = r.requirement_id - 1 AND o.o_totalprice > 495000),
p AS (SELECT v.*, x.part_no, CASE WHEN v.item_no = 1 AND x.part_no = 1 THEN 'First' END AS label,
    CASE WHEN v.item_no = 1 AND x.part_no = 1 THEN 'served' WHEN v.item_no = 1 THEN 'synthesis' WHEN x.part_no = 1 THEN 'external' ELSE 'bogus' END AS disposition FROM rev v, (SELECT 1 AS part_no UNION ALL SELECT 2) x),
l AS (SELECT v.matter_id, v.source, v.ref, CASE WHEN j.kind = 'produces' THEN 2 ELSE 1 END AS part_no, j.kind, CASE WHEN j.kind <> 'produces' THEN j.table_id END AS table_id, CASE WHEN j.kind = 'produces' THEN j.section END AS section, j.code
    FROM rev v JOIN s_judged j ON j.requirement_id = v.requirement_id WHERE v.item_no = 1 OR j.kind <> 'produces')
"""


def replaced(m):
    r = m.a_requirement
    revised = r.where("reason is not null").select("requirement_id", "matter_id", F.upper("source").alias("source"), F.concat(F.lit(" "), "ref").alias("ref"), F.lit(1).alias("item_no"), F.concat(F.lit("Revised "), "title").alias("title"), "disposition")
    again = revised.where(N.fold_label(F.col("disposition")) == "external").withColumn("item_no", F.lit(2))
    big = m.orders.where("o_totalprice > 495000").select((F.col("o_custkey") + 1).alias("requirement_id"), "o_orderpriority")
    added = r.join(big, "requirement_id").select("matter_id", "source", F.concat_ws("-", "ref", "o_orderpriority").alias("ref"), F.lit(3).alias("item_no"), "title").distinct()
    blank = r.where("reason is not null and disposition = 'pending'").select("matter_id", "source", F.lit(" ").alias("ref"), F.lit(4).alias("item_no"), "title")
    both = revised.unionByName(again)
    items = both.select("matter_id", "source", "ref", "item_no", "title").unionByName(added).unionByName(blank)
    part = lambda no, label, disposition: F.struct(F.lit(no).alias("part_no"), F.lit(label).cast("string").alias("label"), F.lit(disposition).alias("disposition"), F.lit(None).cast("string").alias("reason"))
    shape = F.when(F.col("item_no") == 1, F.array(part(1, "First ", "served"), part(2, None, " Synthesis"))).otherwise(F.array(part(1, " ", "External"), part(2, None, "Bogus")))
    new_parts = both.select("matter_id", "source", "ref", "item_no", F.explode(shape).alias("p")).select("matter_id", "source", "ref", "item_no", "p.*")
    no = F.when(N.fold_label(F.col("kind")) == "produces", 2).otherwise(1)
    new_links = both.join(m.a_requirement_link, "requirement_id").select("matter_id", "source", "ref", "item_no", no.alias("part_no"), "kind", "table_name", "section").where("item_no = 1 or part_no = 1")
    place = r.select("requirement_id", "source", "ref")
    stored_links = part_links(m).join(place, "requirement_id")
    return G.replace_parts(parts(m).join(place, "requirement_id"), stored_links, items, new_parts, new_links, m.a_table, m.a_assertion)


@query("register_parts_replaced", f"""{_batch}
SELECT r.matter_id, r.source, r.ref, p.part_no, p.label, p.disposition, p.reason, FALSE AS replaced FROM s_part p JOIN a_requirement r USING (requirement_id) WHERE r.reason IS NULL
UNION ALL SELECT matter_id, upper(source), ref, part_no, label, CASE disposition WHEN 'bogus' THEN 'unassessed' ELSE disposition END, NULL, TRUE FROM p
UNION ALL SELECT matter_id, source, ref, 1, NULL, 'unassessed', NULL, TRUE FROM added""")
def _(m):
    return replaced(m)[0]


@query("register_links_replaced", f"""{_batch}
SELECT r.matter_id, r.source, r.ref, k.part_no, k.kind, k.table_id, k.section FROM s_part_link k JOIN a_requirement r USING (requirement_id) WHERE r.reason IS NULL
UNION ALL SELECT DISTINCT matter_id, upper(source), ref, part_no, kind, table_id, section FROM l WHERE code IS NULL""")
def _(m):
    return replaced(m)[1]


@query("register_batch_findings", f"""{_batch}
SELECT matter_id, 'REQUIREMENT_REF_MISSING' AS code, title AS subject FROM a_requirement WHERE reason IS NOT NULL AND disposition = 'pending'
UNION ALL SELECT matter_id, 'REQUIREMENT_DISPOSITION_INVALID', ref FROM p WHERE disposition = 'bogus' UNION ALL SELECT matter_id, code, ref FROM l WHERE code IS NOT NULL""")
def _(m):
    return replaced(m)[2]
