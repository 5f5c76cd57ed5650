"""Queries: edges, reachability, cycles, order, staleness and what follows from them."""

from pyspark.sql import functions as F

from specaudit.operators import coverage as C
from specaudit.operators import evals as E
from specaudit.operators import freshness as D
from specaudit.operators import graph as G
from specaudit.operators import relational as R
from specaudit.operators import staleness as S
from specaudit.plans.audits import current_prompts, current_rules, fresh
from specaudit.plans.evaluation import latest, snapshots, unticked, vertices
from specaudit.plans.registry import query, sql
from specaudit.plans.relational import edges, targets
from specaudit.session import cut
from specaudit.sources.views import SQL_VIEWS

SQL_VIEWS["s_step"] = "SELECT DISTINCT src, dst FROM {s_edge}"
SQL_VIEWS["s_close"] = """
SELECT root, node, min(depth) AS depth FROM (
  WITH RECURSIVE r(root, node, depth) AS (
    SELECT src, dst, 1 FROM {s_step} UNION SELECT r.root, e.dst, r.depth + 1 FROM r JOIN {s_step} e ON e.src = r.node WHERE r.depth < 26)
  SELECT * FROM r) WHERE root <> node GROUP BY 1, 2"""
SQL_VIEWS["s_cycle"] = """
SELECT node, least(node, min(other)) AS component, count(DISTINCT other) + 1 AS size FROM (
  SELECT a.root AS node, a.node AS other FROM {s_close} a JOIN {s_close} b ON a.root = b.node AND a.node = b.root) GROUP BY 1"""
SQL_VIEWS["s_direct"] = """
WITH last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY column_id ORDER BY started_at DESC, run_id DESC) AS rn FROM {s_snapshot}) WHERE rn = 1),
b AS (SELECT b.table_id, b.column_id, p.resolved_at FROM {a_binding} b JOIN {a_parameter} p USING (parameter_id)),
x AS (SELECT c.column_id, c.table_id, l.run_id, l.started_at, v.prompt_version_id <> l.prompt_version_id AS r1,
        i.instructions_version_id IS NOT NULL AND (l.instructions_version_id IS NULL OR i.instructions_version_id <> l.instructions_version_id) AS r2,
        EXISTS (SELECT 1 FROM b WHERE b.table_id = c.table_id AND (b.column_id IS NULL OR b.column_id = c.column_id) AND b.resolved_at > l.started_at) AS r3
  FROM {a_column} c LEFT JOIN last l USING (column_id)
  LEFT JOIN {a_prompt_version} v ON v.column_id = c.column_id AND v.is_current
  LEFT JOIN {a_instructions} i ON i.table_id = c.table_id AND i.is_current WHERE c.status <> 'retired')
SELECT column_id, table_id, run_id, started_at, CASE WHEN run_id IS NULL THEN 'never_run' WHEN r1 OR r2 OR r3 THEN 'direct' ELSE 'current' END AS state,
  CASE WHEN run_id IS NULL THEN '' ELSE concat_ws('|', CASE WHEN r1 THEN 'prompt version changed' END, CASE WHEN r2 THEN 'table instructions changed' END, CASE WHEN r3 THEN 'shared parameter resolved' END) END AS reasons
FROM x"""
SQL_VIEWS["s_stale"] = """
SELECT d.column_id, d.table_id, d.run_id, CASE WHEN t.column_id IS NOT NULL THEN 'transitive' ELSE d.state END AS state FROM {s_direct} d LEFT JOIN (
  WITH RECURSIVE e AS (
    SELECT DISTINCT s.src, s.dst, d.run_id, d.started_at, u.state AS up_state FROM {s_step} s JOIN {s_direct} d ON d.column_id = s.dst AND d.state = 'current' JOIN {s_direct} u ON u.column_id = s.src),
  t(column_id) AS (
    SELECT e.dst FROM e WHERE up_state = 'direct'
    UNION SELECT e.dst FROM e JOIN {a_prompt_version} v ON v.column_id = e.src AND v.is_current LEFT JOIN {s_snapshot} p ON p.run_id = e.run_id AND p.column_id = e.src
      WHERE CASE WHEN p.column_id IS NOT NULL THEN p.prompt_version_id <> v.prompt_version_id ELSE v.created_at > e.started_at END
    UNION SELECT e.dst FROM e JOIN t ON e.src = t.column_id)
  SELECT DISTINCT column_id FROM t) t USING (column_id)"""


def closure(m):
    return G.downstream_closure(edges(m))


def direct(m):
    last = E.last_run_per_column(snapshots(m))
    return S.staleness_direct(m.a_column, last, current_prompts(m), current_rules(m), m.a_binding, m.a_parameter)


def states(m):
    return m.once("states", lambda: cut(S.staleness(direct(m), edges(m), current_prompts(m), snapshots(m))))


def reliability(m):
    summary = E.column_eval_summary(m.a_column, snapshots(m), latest(m))
    return C.source_reliability(vertices(m), m.a_assertion_source, summary, states(m), unticked(m), fresh(m))


def affected(m, reached):
    """Closure rows with the root itself, placed for ordering."""
    own = reached.select("root").distinct().withColumn("node", F.col("root"))
    return reached.select("root", "node").unionByName(own).join(G.positions(vertices(m)), "node")


@query("build_parameter_edges", """
SELECT DISTINCT p.source_column_id AS src, t.column_id AS dst, 'cross_table_parameter' AS kind, p.parameter_id FROM a_parameter p JOIN s_target t USING (parameter_id)
WHERE p.source_column_id IS NOT NULL AND p.source_column_id <> t.column_id""")
def _(m):
    return G.build_parameter_edges(m.a_parameter, targets(m))


def advisory(m):
    order = m.orders.select(F.col("o_orderkey").alias("column_id"), F.col("o_custkey").alias("p_partkey"), (F.floor(F.col("o_custkey") / 15) + 1).alias("table_id"))
    declared = (
        vertices(m).select("matter_id", "column_id").join(order, "column_id")
        .join(m.a_table.select("table_id", F.col("name").alias("table_name")), "table_id")
        .join(m.part.select("p_partkey", F.concat_ws(" ", "p_name", "p_brand").alias("column_name")), "p_partkey")
    )
    return G.build_advisory_edges(declared, vertices(m))


@query("build_advisory_edges", """
WITH d AS (SELECT v.matter_id, v.column_id, t.name AS table_name, c.p_name || ' ' || c.p_brand AS column_name
  FROM s_vertex v JOIN orders o ON o.o_orderkey = v.column_id JOIN supplier s ON s.s_suppkey = CAST(floor(o.o_custkey / 15) AS BIGINT)
  JOIN a_table t ON t.table_id = s.s_suppkey + 1 JOIN part c ON c.p_partkey = o.o_custkey),
k AS (SELECT matter_id, lower(table_name) AS tk, lower(name) AS ck, min(column_id) AS src FROM s_vertex GROUP BY 1, 2, 3)
SELECT DISTINCT k.src, d.column_id AS dst, k.src IS NOT NULL AS resolved FROM d LEFT JOIN k ON k.matter_id = d.matter_id AND k.tk = lower(d.table_name) AND k.ck = lower(d.column_name)""")
def _(m):
    found, missing = advisory(m)
    lost = missing.select(F.lit(None).cast("bigint").alias("src"), F.col("column_id").alias("dst"), F.lit(False).alias("resolved")).distinct()
    return found.select("src", "dst", F.lit(True).alias("resolved")).unionByName(lost)


@query("advisory_unresolved", f"SELECT dst AS column_id FROM ({sql('build_advisory_edges')}) WHERE NOT resolved")
def _(m):
    return advisory(m)[1].select("column_id").distinct()


@query("downstream_closure", "SELECT root, node, depth, depth = 1 AS direct FROM s_close")
def _(m):
    return closure(m)


@query("upstream_closure", "SELECT node AS root, root AS node, depth, depth = 1 AS direct FROM s_close")
def _(m):
    return G.upstream_closure(edges(m))


@query("impact_via", """
SELECT DISTINCT c.root, c.node, e.src AS via, e.kind FROM s_close c JOIN s_edge e ON e.dst = c.node
WHERE e.src = c.root OR EXISTS (SELECT 1 FROM s_close x WHERE x.root = c.root AND x.node = e.src)""")
def _(m):
    return G.impact_via(cut(closure(m)), edges(m))


@query("tables_affected", "SELECT c.root, v.table_id, count(*) AS n FROM s_close c JOIN s_vertex v ON v.column_id = c.node GROUP BY 1, 2")
def _(m):
    return G.tables_affected(closure(m), vertices(m))


@query("impact_of_column", """
SELECT c.root, count(*) AS affected, count(*) FILTER (c.depth = 1) AS direct, count(*) FILTER (c.depth > 1) AS transitive, max(c.depth) AS longest,
       count(DISTINCT v.table_id) AS tables, coalesce(any_value(r.n), 0) AS assertions_at_risk
FROM s_close c JOIN s_vertex v ON v.column_id = c.node
LEFT JOIN (SELECT root, count(DISTINCT assertion_id) AS n FROM (SELECT root, node FROM s_close UNION SELECT root, root FROM s_close) x
           JOIN a_assertion_source s ON s.column_id = x.node JOIN a_column k ON k.column_id = x.node AND k.status <> 'retired' GROUP BY 1) r ON r.root = c.root GROUP BY 1""")
def _(m):
    reached = cut(closure(m))
    hit = reached.select("root", "node").unionByName(reached.select("root", F.col("root").alias("node")).distinct())
    risk = C.reverse_coverage(hit.select(F.col("root").alias("subject"), F.col("node").alias("column_id")), m.a_assertion_source, m.a_column)
    n = risk.groupBy(F.col("subject").alias("root")).agg(F.count("*").alias("assertions_at_risk"))
    return G.impact_totals(reached, vertices(m)).join(n, "root", "left").fillna(0, ["assertions_at_risk"])


SQL_VIEWS["s_param_hit"] = """
SELECT root, node, min(depth) AS depth FROM (
  WITH RECURSIVE r(root, node, depth) AS (
    SELECT DISTINCT parameter_id, column_id, 0 FROM {s_target} UNION SELECT r.root, e.dst, r.depth + 1 FROM r JOIN {s_step} e ON e.src = r.node WHERE r.depth < 26)
  SELECT * FROM r) GROUP BY 1, 2"""


@query("impact_of_parameter", "SELECT root AS parameter_id, node AS column_id, CASE WHEN depth = 0 THEN 'direct' ELSE 'transitive' END AS impact FROM s_param_hit")
def _(m):
    roots = cut(targets(m).select(F.col("parameter_id").alias("root"), F.col("column_id").alias("node")).distinct())
    reached = G.downstream_closure(edges(m), roots)
    return roots.select(F.col("root").alias("parameter_id"), F.col("node").alias("column_id"), F.lit("direct").alias("impact")).unionByName(
        reached.select(F.col("root").alias("parameter_id"), F.col("node").alias("column_id"), F.lit("transitive").alias("impact")))


@query("cycle_components", "SELECT node, component, size FROM s_cycle")
def _(m):
    return G.cycle_components(edges(m))


SQL_VIEWS["s_wave"] = """
SELECT v.column_id AS node, CASE WHEN b.node IS NULL THEN coalesce(w.wave, 0) END AS wave FROM {s_vertex} v
LEFT JOIN (SELECT DISTINCT c.node FROM {s_cycle} y JOIN {s_close} c ON c.root = y.node UNION SELECT node FROM {s_cycle}) b ON b.node = v.column_id
LEFT JOIN (SELECT node, max(depth) AS wave FROM (
  WITH RECURSIVE r(node, depth) AS (SELECT dst, 1 FROM {s_step} UNION SELECT e.dst, r.depth + 1 FROM r JOIN {s_step} e ON e.src = r.node WHERE r.depth < 40) SELECT * FROM r) GROUP BY 1) w ON w.node = v.column_id"""


@query("impact_detail", f"""
SELECT c.root, c.node, c.depth, c.depth = 1 AS direct, y.node IS NOT NULL AS in_cycle, coalesce(v.n, 0) AS n_via FROM s_close c
LEFT JOIN (SELECT DISTINCT node FROM s_cycle) y ON y.node = c.node LEFT JOIN (SELECT root, node, count(*) AS n FROM ({sql("impact_via")}) GROUP BY 1, 2) v ON v.root = c.root AND v.node = c.node""")
def _(m):
    reached = cut(closure(m))
    return G.impact_detail(reached, G.impact_via(reached, edges(m)), G.cycle_components(edges(m)))


@query("topo_wave", "SELECT node, wave FROM s_wave")
def _(m):
    return G.topo_wave(edges(m), vertices(m).select(F.col("column_id").alias("node")))


@query("rerun_order")
def _(m):
    return G.rerun_order(edges(m), affected(m, cut(closure(m))))


@query("module_layout", """
WITH e AS (SELECT DISTINCT s.src, s.dst, s.kind, a.table_id FROM s_edge s JOIN a_column a ON a.column_id = s.src AND a.status <> 'retired' JOIN a_column b ON b.column_id = s.dst AND b.table_id = a.table_id AND b.status <> 'retired'),
reach AS (SELECT * FROM (WITH RECURSIVE r(root, node) AS (SELECT src, dst FROM e UNION SELECT r.root, e.dst FROM r JOIN e ON e.src = r.node) SELECT * FROM r)),
cyc AS (SELECT DISTINCT root AS node FROM reach WHERE root = node),
bad AS (SELECT node FROM cyc UNION SELECT r.node FROM reach r JOIN cyc ON cyc.node = r.root),
w AS (SELECT node, max(depth) AS wave FROM (WITH RECURSIVE r(node, depth) AS (SELECT dst, 1 FROM e UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < 22) SELECT * FROM r) GROUP BY 1)
SELECT c.table_id, c.column_id AS node, CASE WHEN bad.node IS NULL THEN coalesce(w.wave, 0) END AS level,
       (SELECT count(*) FROM e WHERE e.src = c.column_id) + (SELECT count(*) FROM e WHERE e.dst = c.column_id) AS degree,
       (SELECT count(*) FROM e WHERE e.src = c.column_id OR e.dst = c.column_id) = 0 AS isolated
FROM a_column c LEFT JOIN bad ON bad.node = c.column_id LEFT JOIN w ON w.node = c.column_id WHERE c.status <> 'retired'""")
def _(m):
    return G.module_layout(edges(m), R.active_columns(m.a_column))


@query("components", """
WITH u AS (SELECT src AS a, dst AS b FROM s_step UNION SELECT dst, src FROM s_step),
r AS (SELECT * FROM (WITH RECURSIVE r(a, b) AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON u.a = r.b) SELECT * FROM r))
SELECT a AS node, min(b) AS component, count(DISTINCT b) AS size FROM r GROUP BY 1""")
def _(m):
    return G.components(edges(m))


@query("staleness_direct", "SELECT column_id, table_id, state, reasons, run_id FROM s_direct")
def _(m):
    return direct(m).select("column_id", "table_id", "state", F.array_join("reasons", "|").alias("reasons"), "run_id")


@query("staleness", "SELECT column_id, table_id, state, run_id FROM s_stale")
def _(m):
    return states(m).select("column_id", "table_id", "state", "run_id")


@query("staleness_reasons", """
SELECT column_id, unnest(string_split(d.reasons, '|')) AS reason, CAST(NULL AS BIGINT) AS upstream_id, CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS VARCHAR) AS upstream_state, CAST(NULL AS VARCHAR) AS upstream_version
FROM s_stale s JOIN s_direct d USING (column_id) WHERE s.state = 'direct'
UNION ALL SELECT * FROM (
  SELECT s.column_id, unnest([CASE WHEN u.state IN ('direct', 'transitive') THEN 'upstream stale' END,
    CASE WHEN CASE WHEN p.column_id IS NOT NULL THEN p.prompt_version_id <> v.prompt_version_id ELSE v.created_at > d.started_at END THEN 'upstream changed' END]) AS reason, e.src, e.kind, u.state, v.version
  FROM s_stale s JOIN s_direct d USING (column_id) JOIN (SELECT DISTINCT src, dst, kind FROM s_edge) e ON e.dst = s.column_id JOIN s_stale u ON u.column_id = e.src
  LEFT JOIN a_prompt_version v ON v.column_id = e.src AND v.is_current LEFT JOIN s_snapshot p ON p.run_id = d.run_id AND p.column_id = e.src WHERE s.state = 'transitive') WHERE reason IS NOT NULL""")
def _(m):
    return S.staleness_reasons(states(m), edges(m), current_prompts(m), snapshots(m))


@query("staleness_report", """
SELECT t.matter_id, count(*) FILTER (state = 'never_run') AS never_run, count(*) FILTER (state = 'current') AS current,
       count(*) FILTER (state = 'direct') AS direct, count(*) FILTER (state = 'transitive') AS transitive FROM s_stale JOIN a_table t USING (table_id) GROUP BY 1""")
def _(m):
    return S.staleness_report(states(m), m.a_table)


SQL_VIEWS["s_reliable"] = """
SELECT v.column_id, v.table_id, v.matter_id, v.status, concat_ws('|', CASE WHEN v.status = 'retired' THEN 'retired' END, CASE WHEN r.n IS NULL THEN 'no run' END,
  CASE WHEN f.n > 0 THEN 'open failures' END, CASE WHEN s.state IN ('direct', 'transitive') THEN 'stale' END, CASE WHEN u.n > 0 THEN 'unticked dimensions' END,
  CASE WHEN d.state = 'moved' THEN 'document set moved' END) AS reasons
FROM {s_vertex} v LEFT JOIN (SELECT column_id, count(*) AS n FROM {s_snapshot} GROUP BY 1) r USING (column_id)
LEFT JOIN (SELECT column_id, count(*) AS n FROM {s_latest} WHERE NOT passed GROUP BY 1) f USING (column_id)
LEFT JOIN {s_stale} s USING (column_id) LEFT JOIN (SELECT table_id, count(*) AS n FROM {s_unticked} GROUP BY 1) u ON u.table_id = v.table_id
LEFT JOIN {s_fresh} d ON d.table_id = v.table_id WHERE v.column_id IN (SELECT column_id FROM {a_assertion_source})"""
SQL_VIEWS["s_covered"] = """
SELECT a.matter_id, a.assertion_id, a.section, a.kind, coalesce(p.n, 0) AS sources, a.kind <> 'judgment' AND coalesce(p.n, 0) > coalesce(p.active, 0) AS has_retired_source,
  CASE WHEN a.kind = 'judgment' THEN 'judgment_boundary' WHEN coalesce(p.active, 0) = 0 THEN 'extraction_gap' WHEN p.good > 0 THEN 'reliably_covered' ELSE 'nominally_covered' END AS status
FROM {a_assertion} a LEFT JOIN (SELECT s.assertion_id, count(*) AS n, count(*) FILTER (r.status <> 'retired') AS active, count(*) FILTER (r.status <> 'retired' AND r.reasons = '') AS good
  FROM {a_assertion_source} s JOIN {s_reliable} r USING (column_id) GROUP BY 1) p USING (assertion_id)"""


@query("source_reliability", "SELECT column_id, table_id, status, reasons = '' AS reliable, reasons FROM s_reliable")
def _(m):
    return reliability(m).select("column_id", "table_id", "status", "reliable", F.array_join("reasons", "|").alias("reasons"))


@query("assertion_coverage", "SELECT * FROM s_covered")
def _(m):
    return C.assertion_coverage(m.a_assertion, m.a_assertion_source, reliability(m))


@query("coverage_totals", """
SELECT matter_id, count(*) AS assertions, count(*) FILTER (status = 'reliably_covered') AS reliably_covered, count(*) FILTER (status = 'nominally_covered') AS nominally_covered,
  count(*) FILTER (status = 'extraction_gap') AS extraction_gap, count(*) FILTER (status = 'judgment_boundary') AS judgment_boundary FROM s_covered GROUP BY 1""")
def _(m):
    return C.coverage_totals(C.assertion_coverage(m.a_assertion, m.a_assertion_source, reliability(m)))


@query("reverse_coverage", """
WITH hit AS (SELECT DISTINCT t.matter_id AS subject, s.column_id FROM s_stale s JOIN a_table t USING (table_id) WHERE s.state IN ('direct', 'transitive', 'never_run')),
act AS (SELECT s.assertion_id, s.column_id FROM a_assertion_source s JOIN a_column c USING (column_id) WHERE c.status <> 'retired')
SELECT h.subject, a.assertion_id, count(*) AS hit, any_value(n.active) AS active, CASE WHEN count(*) = any_value(n.active) THEN 'unsupported' ELSE 'weakened' END AS status
FROM hit h JOIN act a USING (column_id) JOIN (SELECT assertion_id, count(*) AS active FROM act GROUP BY 1) n USING (assertion_id) GROUP BY 1, 2""")
def _(m):
    return _at_risk(m)


def _at_risk(m):
    hit = states(m).where("state in ('direct', 'transitive', 'never_run')").join(m.a_table.select("table_id", "matter_id"), "table_id")
    return C.reverse_coverage(hit.select(F.col("matter_id").alias("subject"), "column_id"), m.a_assertion_source, m.a_column)


@query("assertions_at_risk", f"SELECT subject AS matter_id, assertion_id, status FROM ({sql('reverse_coverage')})")
def _(m):
    return _at_risk(m).select(F.col("subject").alias("matter_id"), "assertion_id", "status")


@query("stale_rerun_order")
def _(m):
    return S.stale_rerun_order(states(m), edges(m), m.a_table, vertices(m)).select("matter_id", "table_id", "column_id", "state", "seq")


@query("lifecycle_findings", """
SELECT c.table_id, c.column_id, code FROM (SELECT c.table_id, c.column_id, unnest([CASE WHEN c.status IN ('draft', 'testing') THEN 'COLUMN_NOT_VERIFIED' END,
  CASE WHEN s.state IN ('direct', 'transitive') THEN 'COLUMN_STALE' END, CASE WHEN s.state = 'never_run' THEN 'COLUMN_NEVER_RUN' END]) AS code
  FROM a_column c LEFT JOIN s_stale s USING (column_id) WHERE c.status <> 'retired') c WHERE code IS NOT NULL""")
def _(m):
    return S.lifecycle_findings(m.a_column, states(m))
