"""Queries: what drifts apart across tables, and similarity of names and texts."""

from pyspark.sql import functions as F

from specaudit import vocab
from specaudit.functions import text as T
from specaudit.operators import consistency as C
from specaudit.operators.similarity import near_duplicate_texts
from specaudit.operators.versioning import effective_standard, standard_carry_forward
from specaudit.plans.audits import current_prompts, current_rules
from specaudit.plans.evaluation import vertices
from specaudit.plans.registry import query
from specaudit.plans.relational import edges, texts
from specaudit.plans.scalars import _dates
from specaudit.session import cut
from specaudit.sources.views import SQL_VIEWS

_stop = ", ".join(f"'{w}'" for w in vocab.NAME_STOP_WORDS)
_qual = ", ".join(f"'{w}'" for w in vocab.NAME_QUALIFIERS)
_suffix = T.suffix_alternatives()
_vocab = ", ".join(f"'{v}'" for v in vocab.FALLBACK_VOCABULARY)

SQL_VIEWS["s_std"] = """
SELECT m.matter_id, coalesce(f.date_pattern, o.date_pattern) AS date_pattern, coalesce(f.currency_pattern, o.currency_pattern) AS currency_pattern
FROM {a_matter} m CROSS JOIN (SELECT last(date_pattern ORDER BY version) FILTER (date_pattern IS NOT NULL) AS date_pattern, last(currency_pattern ORDER BY version) FILTER (currency_pattern IS NOT NULL) AS currency_pattern
  FROM {a_standard} WHERE scope = 'firm') f
LEFT JOIN (SELECT matter_id, last(date_pattern ORDER BY version) FILTER (date_pattern IS NOT NULL) AS date_pattern, last(currency_pattern ORDER BY version) FILTER (currency_pattern IS NOT NULL) AS currency_pattern
  FROM {a_standard} WHERE scope = 'matter' GROUP BY 1) o USING (matter_id)"""
SQL_VIEWS["s_desc"] = f"""
SELECT v.matter_id, v.table_id, v.column_id, v.name, lower(trim(v.name)) AS name_key, v.native_type, v.role, nullif(lower(trim(c.concept)), '') AS concept, c.options, coalesce(f.fallbacks, '') AS fallbacks
FROM {{s_vertex}} v JOIN {{a_column}} c USING (column_id) JOIN {{a_prompt_version}} p ON p.column_id = v.column_id AND p.is_current
LEFT JOIN (SELECT prompt_version_id, string_agg(t, '|' ORDER BY i) AS fallbacks FROM (SELECT DISTINCT s.prompt_version_id, w.t, w.i FROM {{s_presented}} s
  JOIN (SELECT unnest([{_vocab}]) AS t, unnest(range(5)) AS i) w ON lower(w.t) = s.tok) GROUP BY 1) f USING (prompt_version_id) WHERE v.status <> 'retired'"""
SQL_VIEWS["s_spread"] = """
SELECT matter_id, 'concept' AS basis, concept AS key, count(*) AS members, count(DISTINCT table_id) AS tables, count(DISTINCT name) AS names, count(DISTINCT native_type) AS types,
  count(DISTINCT options) AS option_sets, count(DISTINCT fallbacks) AS fallback_sets, FALSE AS settled FROM {s_desc} WHERE concept IS NOT NULL GROUP BY matter_id, concept
UNION ALL SELECT matter_id, 'name', name_key, count(*), count(DISTINCT table_id), count(DISTINCT name), count(DISTINCT native_type), count(DISTINCT options), count(DISTINCT fallbacks),
  count(concept) = count(*) AND count(DISTINCT concept) = 1 FROM {s_desc} GROUP BY matter_id, name_key"""
SQL_VIEWS["s_name"] = f"""
SELECT matter_id, id, list_filter(list_distinct(regexp_extract_all(id, '[a-z0-9]+')), lambda x: x NOT IN ({_stop})) AS tokens FROM (
  SELECT matter_id, name_key AS id FROM {{s_desc}} GROUP BY 1, 2 HAVING count(*) > count(concept))"""
SQL_VIEWS["s_namelink"] = """
SELECT a.matter_id, a.id AS a, b.id AS b, len(list_intersect(a.tokens, b.tokens)) / len(list_distinct(list_concat(a.tokens, b.tokens))) AS score FROM {s_name} a JOIN {s_name} b
ON a.matter_id = b.matter_id AND a.id < b.id AND len(a.tokens) >= 2 AND len(b.tokens) >= 2 AND len(list_intersect(a.tokens, b.tokens)) / len(list_distinct(list_concat(a.tokens, b.tokens))) >= 0.6"""
SQL_VIEWS["s_namecluster"] = """
SELECT matter_id, name, min(other) AS cluster FROM (WITH RECURSIVE u AS (SELECT matter_id, a, b FROM {s_namelink} UNION SELECT matter_id, b, a FROM {s_namelink}),
  r(matter_id, name, other) AS (SELECT matter_id, a, b FROM u UNION SELECT r.matter_id, r.name, u.b FROM r JOIN u ON u.matter_id = r.matter_id AND u.a = r.other) SELECT * FROM r) GROUP BY 1, 2"""
SQL_VIEWS["s_graded"] = f"""
SELECT k.matter_id, k.cluster, k.names, l.links, d.tables, concat_ws('|', CASE WHEN l.links < k.names * (k.names - 1) / 2 THEN 'joined transitively' END,
  CASE WHEN EXISTS (SELECT 1 FROM (SELECT unnest(n.tokens) AS t FROM {{s_namecluster}} c JOIN {{s_name}} n ON n.matter_id = c.matter_id AND n.id = c.name WHERE c.matter_id = k.matter_id AND c.cluster = k.cluster) x
     WHERE t IN ({_qual}) GROUP BY t HAVING count(*) < k.names) THEN 'qualifier' END, CASE WHEN d.oriented AND d.other THEN 'orientation' END) AS reasons
FROM (SELECT matter_id, cluster, count(*) AS names FROM {{s_namecluster}} GROUP BY 1, 2) k
JOIN (SELECT c.matter_id, c.cluster, count(*) AS links FROM {{s_namelink}} l JOIN {{s_namecluster}} c ON c.matter_id = l.matter_id AND c.name = l.a GROUP BY 1, 2) l USING (matter_id, cluster)
JOIN (SELECT c.matter_id, c.cluster, count(DISTINCT table_id) AS tables, bool_or(role = 'orientation') AS oriented, bool_or(role <> 'orientation') AS other
  FROM {{s_desc}} s JOIN {{s_namecluster}} c ON c.matter_id = s.matter_id AND c.name = s.name_key GROUP BY 1, 2) d USING (matter_id, cluster) WHERE d.tables >= 2"""


def standards(m):
    return effective_standard(m.a_matter, standard_carry_forward(m.a_standard))


def entities(m):
    return m.a_entity.select("matter_id", "name")


def described(m):
    return C.described_columns(vertices(m), m.a_column, current_prompts(m))


def name_links(m):
    return C.similar_name_links(C.candidate_names(described(m)))


def graded(m):
    d, links = cut(described(m)), cut(name_links(m))
    return C.name_cluster_confidence(cut(C.name_clusters(links)), links, d)


@query("dep_on_retired", """
SELECT e.src, e.dst, e.kind FROM s_edge e JOIN a_column a ON a.column_id = e.src JOIN a_column b ON b.column_id = e.dst WHERE a.status = 'retired' AND b.status <> 'retired'""")
def _(m):
    return C.dep_on_retired(edges(m), vertices(m))


@query("role_order", f"""
WITH r(role, k) AS (VALUES {", ".join(f"('{r}', {i})" for i, r in enumerate(vocab.COLUMN_ROLES))})
SELECT e.src, e.dst, e.kind, a.role AS src_role, b.role AS dst_role FROM s_edge e JOIN a_column a ON a.column_id = e.src JOIN a_column b ON b.column_id = e.dst
JOIN r ra ON ra.role = a.role JOIN r rb ON rb.role = b.role WHERE ra.k > rb.k AND b.status <> 'retired'""")
def _(m):
    return C.role_order(edges(m), vertices(m))


@query("control_plane", """
SELECT a.column_id, count(DISTINCT e.dst) AS dependents FROM s_edge e JOIN a_column a ON a.column_id = e.src JOIN a_column b ON b.column_id = e.dst
WHERE e.kind = 'intra_table_ref' AND a.status <> 'retired' AND b.status <> 'retired' AND a.native_type IN ('FreeResponse', 'Verbatim') GROUP BY 1 HAVING count(DISTINCT e.dst) >= 2""")
def _(m):
    return C.control_plane(edges(m), vertices(m))


@query("instructions_missing", """
SELECT matter_id, table_id FROM a_table WHERE table_id IN (SELECT table_id FROM a_column WHERE status <> 'retired') AND table_id NOT IN (SELECT table_id FROM a_instructions WHERE is_current)""")
def _(m):
    return C.instructions_missing(m.a_table, m.a_column, current_rules(m))


@query("instructions_vocabulary", f"""
SELECT table_id, version, missing FROM (SELECT table_id, version, (SELECT string_agg(t, '|' ORDER BY i) FROM (SELECT unnest([{_vocab}]) AS t, unnest(range(5)) AS i) WHERE NOT contains(lower(text), lower(t))) AS missing
FROM a_instructions WHERE is_current) WHERE missing IS NOT NULL""")
def _(m):
    return C.instructions_vocabulary(current_rules(m), vocab.FALLBACK_VOCABULARY).withColumn("missing", F.array_join("missing", "|"))


_variants = f"""
SELECT DISTINCT matter_id, table_id, column_id, site, standard_name, f AS variant FROM (
  SELECT x.*, e.name AS standard_name, unnest(list_transform(regexp_extract_all(x.text, '(?i)\\b' || regexp_escape(replace(e.name, ', LLC', '')) || '(?:\\s*,?\\s*(?:{_suffix})\\.?)?'), lambda y: trim(regexp_replace(y, '\\s+', ' ', 'g')))) AS f
  FROM s_text x JOIN a_entity e USING (matter_id)) WHERE f <> standard_name AND NOT (rtrim(f, '.') = rtrim(standard_name, '.') AND lower(f) = lower(standard_name))"""


@query("entity_variants", _variants)
def _(m):
    return C.entity_variants(texts(m), entities(m))


@query("entity_name_variant", f"SELECT matter_id, site, standard_name, variant, count(*) AS sites FROM ({_variants}) GROUP BY 1, 2, 3, 4")
def _(m):
    return C.entity_variants(texts(m), entities(m)).groupBy("matter_id", "site", "standard_name", "variant").agg(F.count("*").alias("sites"))


def _diverge_sql(found: str, standard: str) -> str:
    return f"""
WITH p AS (SELECT matter_id, v AS pattern, count(*) AS n_samples, count(DISTINCT (table_id, column_id)) AS n_sites FROM ({found}) GROUP BY 1, 2),
q AS (SELECT p.*, {standard} AS standard, count(*) OVER (PARTITION BY p.matter_id) AS k FROM p LEFT JOIN s_std s USING (matter_id))
SELECT matter_id, pattern, standard, n_samples, n_sites FROM q WHERE CASE WHEN standard IS NOT NULL THEN pattern <> standard ELSE k > 1 END"""


_style = r"trim(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '\d', '9', 'g'), '9[9,]*,[9,]*9', '#', 'g'), '99+', '9999', 'g'), '\.9+', '.99', 'g'), '#', '9,999'))"


@query("date_divergence", _diverge_sql(
    f"SELECT matter_id, table_id, column_id, unnest(list_distinct(regexp_extract_all(text, '{_dates}'))) AS v FROM s_text", "s.date_pattern"))
def _(m):
    return C.date_divergence(texts(m), standards(m))


@query("currency_divergence", _diverge_sql(
    f"SELECT matter_id, table_id, column_id, {_style.replace('{x}', 'y')} AS v FROM (SELECT *, unnest(list_distinct(regexp_extract_all(text, '{vocab.CURRENCY_PATTERN}'))) AS y FROM s_text)",
    _style.replace("{x}", "s.currency_pattern")))
def _(m):
    return C.currency_divergence(texts(m), standards(m))


@query("concept_divergence", "SELECT matter_id, key AS concept, members, tables, types, option_sets, fallback_sets FROM s_spread WHERE basis = 'concept'")
def _(m):
    return C.concept_divergence(described(m))


@query("concept_name_variant_tagged", "SELECT matter_id, key AS concept, names, members, tables FROM s_spread WHERE basis = 'concept' AND tables >= 2 AND names > 1")
def _(m):
    return C.concept_name_variant_tagged(described(m))


@query("concept_divergent_rules", """
SELECT matter_id, basis, key, members, types, option_sets, fallback_sets FROM s_spread WHERE tables >= 2 AND (types > 1 OR option_sets > 1 OR fallback_sets > 1) AND NOT settled""")
def _(m):
    return C.concept_divergent_rules(described(m))


@query("option_overlap", """
WITH d AS (SELECT matter_id, p_name AS name_key, column_id, list_sort(list_distinct(string_split(options, '|'))) AS o FROM s_vertex v JOIN a_column c USING (column_id) JOIN part ON p_partkey = column_id - 1 WHERE options IS NOT NULL AND v.status <> 'retired'),
g AS (SELECT matter_id, name_key, count(*) AS members, count(DISTINCT o) AS distinct_sets FROM d GROUP BY 1, 2 HAVING count(DISTINCT o) > 1)
SELECT matter_id, name_key, option, count(*) AS holders, any_value(members) AS members, any_value(distinct_sets) AS distinct_sets, count(*) = any_value(members) AS shared
FROM (SELECT matter_id, name_key, unnest(o) AS option FROM d) JOIN g USING (matter_id, name_key) GROUP BY 1, 2, 3""")
def _(m):
    base = R_active(m).join(m.a_column.select("column_id", "options"), "column_id")
    named = base.join(m.part.select((F.col("p_partkey") + 1).alias("column_id"), F.col("p_name").alias("name_key")), "column_id")
    return C.option_overlap(named.select("matter_id", "name_key", "column_id", "options"))


def R_active(m):
    return vertices(m).where("status <> 'retired'").select("matter_id", "column_id")


@query("tagging_progress", "SELECT matter_id, count(c.concept) AS tagged, count(*) AS total FROM s_vertex v JOIN a_column c USING (column_id) WHERE v.status <> 'retired' GROUP BY 1")
def _(m):
    return C.tagging_progress(vertices(m), m.a_column)


@query("similar_name_links", "SELECT * FROM s_namelink")
def _(m):
    return name_links(m)


@query("name_clusters", "SELECT * FROM s_namecluster")
def _(m):
    return C.name_clusters(name_links(m))


@query("name_cluster_confidence", "SELECT matter_id, cluster, names, links, tables, CASE WHEN reasons = '' THEN 'strong' ELSE 'possible' END AS confidence, reasons FROM s_graded")
def _(m):
    return graded(m).withColumn("reasons", F.array_join("reasons", "|"))


@query("variant_rank", "SELECT matter_id, cluster, names, CASE WHEN reasons = '' THEN 'strong' ELSE 'possible' END AS confidence FROM s_graded")
def _(m):
    return C.variant_rank(graded(m)).select("matter_id", "cluster", "names", "confidence")


@query("heuristic_precision", """
SELECT avg(CASE WHEN reasons = '' THEN CAST(label = 'same' AS INT) END) AS strong_precision, avg(CASE WHEN reasons <> '' THEN CAST(label <> 'same' AS INT) END) AS possible_precision,
       avg(CAST((reasons = '') = (label = 'same') AS INT)) AS graded_correctly
FROM s_graded g JOIN (SELECT matter_id, name_key AS cluster, CASE WHEN count(DISTINCT native_type) = 1 THEN 'same' WHEN bool_or(role IS NULL) THEN 'unclear' ELSE 'different' END AS label FROM s_desc GROUP BY 1, 2) l
USING (matter_id, cluster) WHERE label <> 'unclear'""")
def _(m):
    # a cluster counts as one question here when every column of its first name has one type
    d = described(m).groupBy("matter_id", F.col("name_key").alias("cluster")).agg(
        F.when(F.countDistinct("native_type") == 1, "same").when(F.bool_or(F.col("role").isNull()), "unclear").otherwise("different").alias("label"))
    return C.heuristic_precision(graded(m), d)


@query("near_duplicate_texts", """
WITH t AS (SELECT doc_id, list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) > 3))) AS k FROM documents),
h AS (SELECT k, min(doc_id) AS head, len(k) AS n FROM t WHERE len(k) > 0 GROUP BY 1),
x AS (SELECT head, n, unnest(k) AS tok FROM h),
p AS (SELECT a.head AS a, b.head AS b, count(*) AS shared, any_value(a.n) AS na, any_value(b.n) AS nb FROM x a JOIN x b ON a.tok = b.tok AND a.head < b.head GROUP BY 1, 2)
SELECT a, b, shared / (na + nb - shared) AS score FROM p WHERE shared / (na + nb - shared) >= 0.6
UNION ALL SELECT h.head, t.doc_id, 1.0 FROM t JOIN h ON h.k = t.k WHERE t.doc_id <> h.head""")
def _(m):
    return near_duplicate_texts(m.documents.select(F.col("doc_id").alias("id"), T.content_tokens(F.col("text")).alias("tokens")), 0.6)


@query("concept_tagging", """
WITH w AS (SELECT DISTINCT matter_id, lower(trim(name)) AS nk FROM s_vertex WHERE native_type = 'Date'),
x AS (SELECT DISTINCT matter_id, lower(trim(table_name)) AS tk, lower(trim(name)) AS nk FROM s_vertex WHERE role = 'orientation')
SELECT c.column_id, CASE WHEN v.status = 'retired' THEN c.concept WHEN x.nk IS NOT NULL THEN 'profile' WHEN w.nk IS NOT NULL THEN 'dated' ELSE c.concept END AS concept
FROM a_column c JOIN s_vertex v USING (column_id) LEFT JOIN w ON w.matter_id = v.matter_id AND w.nk = lower(trim(v.name)) LEFT JOIN x ON x.matter_id = v.matter_id AND x.tk = lower(trim(v.table_name)) AND x.nk = lower(trim(v.name))""")
def _(m):
    v = vertices(m)
    name = F.lower(F.trim("name")).alias("name_key")
    wide = v.where("native_type = 'Date'").select("matter_id", F.lit(None).cast("string").alias("table_key"), name, F.lit("dated").alias("concept")).distinct()
    exact = v.where("role = 'orientation'").select("matter_id", F.lower(F.trim("table_name")).alias("table_key"), name, F.lit("profile").alias("concept")).distinct()
    tagged, _lost = C.concept_tagging(m.a_column, v, wide.unionByName(exact))
    return tagged.select("column_id", "concept")
