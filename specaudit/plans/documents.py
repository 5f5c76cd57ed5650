"""Queries: rule documents, their audit, and what changed between two editions."""

from pyspark.sql import functions as F

from specaudit import vocab
from specaudit.functions import text as T
from specaudit.operators import documents as D
from specaudit.plans.registry import query, sql
from specaudit.session import cut
from specaudit.sources.views import SQL_VIEWS

_fields = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in vocab.FIELD_HEADINGS.items())
_pre = ", ".join(f"'{k}'" for k in vocab.PREAMBLE_HEADINGS)
_words = "list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda w: length(w) > 3))"

SQL_VIEWS["s_fill"] = f"""
WITH k AS (SELECT *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS title, CASE lower(rtrim(trim(text), ':')) {_fields} END AS fslot, lower(rtrim(trim(text), ':')) AS hkey FROM {{a_block}}),
c AS (SELECT *, CASE WHEN NOT is_heading THEN 'text' WHEN hkey IN ({_pre}) THEN 'preamble' WHEN fslot IS NOT NULL THEN 'field' ELSE 'rule' END AS kind FROM k),
w AS (SELECT *, max(CASE WHEN kind IN ('rule', 'preamble') THEN seq END) OVER o AS owner_seq, max(CASE WHEN kind = 'field' THEN seq END) OVER o AS field_seq FROM c WINDOW o AS (PARTITION BY playbook_id, edition ORDER BY seq))
SELECT w.playbook_id, w.edition, w.seq, w.owner_seq, h.kind AS owner_kind, h.title AS heading, CASE WHEN h.kind = 'rule' AND w.field_seq > w.owner_seq THEN f.fslot END AS slot,
       CASE WHEN w.field_seq > coalesce(w.owner_seq, -1) THEN w.field_seq END AS slot_seq, w.title AS text
FROM w LEFT JOIN c h ON h.playbook_id = w.playbook_id AND h.edition = w.edition AND h.seq = w.owner_seq LEFT JOIN c f ON f.playbook_id = w.playbook_id AND f.edition = w.edition AND f.seq = w.field_seq
WHERE w.kind = 'text'"""
SQL_VIEWS["s_field"] = """
SELECT playbook_id, edition, owner_seq, any_value(heading) AS name,
  coalesce(string_agg(text, chr(10) ORDER BY seq) FILTER (slot = 'standard' AND slot_seq = m), '') AS standard,
  coalesce(list(text ORDER BY seq) FILTER (slot = 'acceptable'), []) AS acceptable, coalesce(list(text ORDER BY seq) FILTER (slot = 'unacceptable'), []) AS unacceptable,
  coalesce(string_agg(text, chr(10) ORDER BY seq) FILTER (slot = 'guidance' AND slot_seq = m), '') AS guidance, coalesce(list(text ORDER BY seq) FILTER (slot = 'workflow'), []) AS workflow,
  arg_min(CASE WHEN slot = 'required' THEN starts_with(lower(text), 'y') ELSE NOT starts_with(lower(text), 'y') END, (-slot_seq, seq)) FILTER (slot IN ('required', 'optional')) AS required
FROM (SELECT *, max(slot_seq) OVER (PARTITION BY playbook_id, edition, owner_seq, slot) AS m FROM {s_fill} WHERE owner_kind = 'rule' AND text <> '') GROUP BY 1, 2, 3 HAVING bool_or(slot IS NOT NULL)"""
SQL_VIEWS["s_rule"] = f"""
SELECT *, row_number() OVER (PARTITION BY playbook_id, edition ORDER BY owner_seq) AS position, regexp_replace(nullif(regexp_extract(guidance, '(?im){vocab.RULE_ID_LINE}', 1), ''), '[.,;]+$', '') AS rule_id,
  regexp_extract(guidance, '(?im){vocab.DEPENDS_LINE}', 1) AS dep, nullif(trim(regexp_extract(guidance, '(?im){vocab.PRECEDENCE_LINE}', 1)), '') AS precedence,
  nullif(trim(regexp_extract(guidance, '(?im){vocab.EXHAUSTION_LINE}', 1)), '') AS on_exhaustion FROM {{s_field}}"""
SQL_VIEWS["s_dep"] = f"""
SELECT * FROM (SELECT playbook_id, edition, position, name, regexp_replace(unnest(regexp_extract_all(dep, '{vocab.DEPENDENCY_ITEM}', 1)), '[.,;]+$', '') AS ref,
  nullif(trim(unnest(regexp_extract_all(dep, '{vocab.DEPENDENCY_ITEM}', 2))), '') AS reason FROM {{s_rule}}) WHERE lower(ref) NOT IN ('and', 'or')"""
SQL_VIEWS["s_mention"] = """
SELECT a.playbook_id, a.edition, a.position, b.position AS position_b, a.name AS rule_a, b.name AS rule_b FROM {s_rule} a JOIN {s_rule} b
ON a.playbook_id = b.playbook_id AND a.edition = b.edition AND a.position <> b.position AND contains(lower(a.precedence), lower(b.name))"""
SQL_VIEWS["s_prefix"] = """
SELECT a.playbook_id, a.edition, a.position, b.position AS position_b, a.name AS rule_a, b.name AS rule_b FROM {s_rule} a JOIN {s_rule} b
ON a.playbook_id = b.playbook_id AND a.edition = b.edition AND a.position <> b.position AND starts_with(lower(b.name), lower(a.name) || ' ')"""
_head = "SELECT playbook_id, edition, position, name AS rule, "


def runs(m):
    return m.once("heading_runs", lambda: D.heading_runs(m.a_block))


def akin_runs(m):
    return m.once("heading_runs", lambda: D.heading_runs(m.a_block, akin=True))


def filled(m):
    return m.once("filled", lambda: D.fill_of_runs(runs(m)))


def rules(m):
    return D.rules_of_runs(runs(m))


def editions(m, *columns):
    """Both editions with no other fields of the rules than these, or all; fields left out are not even looked for."""
    r = cut(rules(m).select(*D.DOC, "position", "name", *columns) if columns else rules(m))
    return r.where("edition = 1"), r.where("edition = 2")


@query("heading_fill", "SELECT playbook_id, edition, seq, heading, slot, text FROM s_fill")
def _(m):
    return filled(m).select("playbook_id", "edition", "seq", "heading", "slot", "text")


@query("parse_rules", """
SELECT playbook_id, edition, position, name, standard, array_to_string(acceptable, '|') AS acceptable, array_to_string(unacceptable, '|') AS unacceptable, guidance, required, rule_id, precedence, on_exhaustion FROM s_rule""")
def _(m):
    return rules(m).select(
        "playbook_id", "edition", "position", "name", "standard", F.array_join("acceptable", "|").alias("acceptable"),
        F.array_join("unacceptable", "|").alias("unacceptable"), "guidance", "required", "rule_id", "precedence", "on_exhaustion")


@query("rule_id_missing", _head + "'RULE_ID_MISSING' AS code, '' AS evidence FROM s_rule WHERE rule_id IS NULL")
def _(m):
    return D.rule_id_missing(rules(m))


@query("duplicate_rule_ids", """
SELECT playbook_id, edition, rule_id, name, other FROM (SELECT *, lag(name) OVER (PARTITION BY playbook_id, edition, rule_id ORDER BY position) AS other FROM s_rule WHERE rule_id IS NOT NULL) WHERE other IS NOT NULL
UNION ALL SELECT playbook_id, edition, dep_id, name, other FROM (SELECT *, split_part(rule_id, '.', 1) AS dep_id, lag(name) OVER (PARTITION BY playbook_id, edition, split_part(rule_id, '.', 1) ORDER BY position) AS other FROM s_rule WHERE rule_id IS NOT NULL) WHERE other IS NOT NULL""")
def _(m):
    r = cut(rules(m))
    # full identities, then chapters (the part before the first dot), which repeat often
    chapters = r.withColumn("rule_id", F.substring_index("rule_id", ".", 1))
    return D.duplicate_rule_ids(r).unionByName(D.duplicate_rule_ids(chapters))


@query("absence_missing", _head + f"""'ABSENCE_REMEDIATION_MISSING' AS code, '' AS evidence FROM (SELECT *, regexp_extract(standard, '(?is)(({vocab.ABSENCE_CLAUSE}).*)$', 1) AS tail FROM s_rule)
WHERE required AND NOT (tail <> '' AND (regexp_matches(tail, '(?i){vocab.ABSENCE_ESCALATES}') OR regexp_matches(tail, '(?i){vocab.ABSENCE_ACCEPTABLE}') OR regexp_matches(tail, '{vocab.OPERATIVE_WORDING}')))""")
def _(m):
    return D.absence_missing(rules(m))


@query("deviation_missing", _head + "'NO_ACCEPTABLE_DEVIATION' AS code, '' AS evidence FROM s_rule WHERE len(acceptable) = 0 UNION ALL " + _head + "'UNACCEPTABLE_NOT_STATED', '' FROM s_rule WHERE len(unacceptable) = 0")
def _(m):
    return D.deviation_missing(rules(m))


@query("deviation_unspecified", _head + f"""'DEVIATION_UNSPECIFIED' AS code, e AS evidence FROM (SELECT *, unnest(acceptable) AS e FROM s_rule) WHERE regexp_matches(trim(e), '(?i){vocab.ONLY_REASONABLE}')""")
def _(m):
    return D.deviation_unspecified(rules(m))


@query("prose_gate", _head + f"'PROSE_SUBSTITUTES_FOR_STRUCTURE' AS code, regexp_extract(guidance, '(?i){vocab.PROSE_GATE}', 1) AS evidence FROM s_rule WHERE regexp_matches(guidance, '(?i){vocab.PROSE_GATE}')")
def _(m):
    return D.prose_gate(rules(m))


@query("depends_unresolved", _head + """'DEPENDS_ON_UNRESOLVED' AS code, ref AS evidence FROM s_dep d WHERE NOT EXISTS (SELECT 1 FROM s_rule r WHERE r.playbook_id = d.playbook_id AND r.edition = d.edition AND r.rule_id = d.ref)
UNION ALL """ + _head + "'DEPENDENCY_REASON_MISSING', ref FROM s_dep WHERE reason IS NULL")
def _(m):
    return D.depends_unresolved(cut(rules(m)))


@query("ladder_gap", _head + f"""'LADDER_GAP' AS code, trim(c) || ' / ' || u AS evidence FROM (
  SELECT *, regexp_extract(array_to_string(acceptable, ' '), '(?i){vocab.BOUNDED_TERM}') AS c, regexp_extract(array_to_string(unacceptable, ' '), '(?i){vocab.UNBOUNDED_TERM}') AS u,
    regexp_extract(array_to_string(unacceptable, ' '), '(?i){vocab.BOUNDED_TERM}') AS ub FROM s_rule) WHERE c <> '' AND u <> '' AND ub = ''""")
def _(m):
    return D.ladder_gap(rules(m))


@query("rule_name_mentions", "SELECT * FROM s_mention")
def _(m):
    return D.rule_name_mentions(cut(rules(m).select(*D.DOC, "position", "name", "precedence")))


@query("precedence_one_sided", """
SELECT playbook_id, edition, position, rule_a AS rule, 'PRECEDENCE_ONE_SIDED' AS code, rule_b AS evidence FROM s_mention a
WHERE NOT EXISTS (SELECT 1 FROM s_mention b WHERE b.playbook_id = a.playbook_id AND b.edition = a.edition AND b.position = a.position_b AND b.position_b = a.position)""")
def _(m):
    return D.precedence_one_sided(cut(rules(m).select(*D.DOC, "position", "name", "precedence")))


@query("rule_name_prefix_pairs", "SELECT * FROM s_prefix")
def _(m):
    return D.rule_name_prefix_pairs(cut(rules(m)))


_down, _up = _words.replace("{x}", "b.standard"), _words.replace("{x}", "array_to_string(a.acceptable, ' ') || ' ' || a.standard")


@query("parent_child_duplication", f"""
SELECT playbook_id, edition, position, rule, parent, round(o, 2) AS overlap FROM (
  SELECT p.playbook_id, p.edition, p.position_b AS position, p.rule_b AS rule, p.rule_a AS parent, CASE WHEN len({_down}) > 0 THEN len(list_intersect({_down}, {_up})) / len({_down}) ELSE 0 END AS o
  FROM s_prefix p JOIN s_rule a ON a.playbook_id = p.playbook_id AND a.edition = p.edition AND a.position = p.position
  JOIN s_rule b ON b.playbook_id = p.playbook_id AND b.edition = p.edition AND b.position = p.position_b WHERE b.standard <> '') WHERE o >= 0.5""")
def _(m):
    texts = cut(D.akin_texts(akin_runs(m)))
    return D.parent_child_duplication(cut(rules(m).select(*D.DOC, "position", "name")), texts)


_win, _pos = _words.replace("{x}", "win"), _words.replace("{x}", "concat_ws(' ', standard, array_to_string(acceptable, ' '))")


@query("preamble_restates", _head + f"""'PREAMBLE_RESTATES_RULE' AS code, short AS evidence FROM (
  SELECT r.*, short, substr(p.low, strpos(p.low, short), 240) AS win FROM (SELECT *, trim(split_part(lower(name), ' / ', 1)) AS short FROM s_rule) r
  JOIN (SELECT playbook_id, edition, lower(string_agg(text, chr(10) ORDER BY seq)) AS low FROM s_fill WHERE owner_kind = 'preamble' AND text <> '' GROUP BY 1, 2) p USING (playbook_id, edition)
  WHERE length(short) >= 6 AND contains(p.low, short)) WHERE len({_win}) > 0 AND len(list_intersect({_win}, {_pos})) / len({_win}) >= 0.35""")
def _(m):
    return D.preamble_restates(rules(m), filled(m))


@query("document_level", f"""
WITH f AS (SELECT playbook_id, edition, bool_or(regexp_matches(text, '(?i){vocab.DOCUMENT_CONTROL}')) AS control, bool_or(regexp_matches(text, '(?i)exhaustion')) AS path FROM s_fill x
  WHERE text <> '' AND (owner_kind = 'preamble' OR (owner_kind = 'rule' AND NOT EXISTS (SELECT 1 FROM s_field r WHERE r.playbook_id = x.playbook_id AND r.edition = x.edition AND r.owner_seq = x.owner_seq))) GROUP BY 1, 2),
r AS (SELECT playbook_id, edition, count(*) AS rules, bool_or(on_exhaustion IS NOT NULL) AS rp FROM s_rule GROUP BY 1, 2)
SELECT playbook_id, edition, rules, code FROM (SELECT *, unnest([CASE WHEN NOT coalesce(control, FALSE) THEN 'DOCUMENT_CONTROL_MISSING' END, CASE WHEN NOT coalesce(path, FALSE) AND NOT rp THEN 'EXHAUSTION_DEFAULT_MISSING' END,
  CASE WHEN rules > 60 THEN 'RULE_COUNT_HIGH' END]) AS code FROM r LEFT JOIN f USING (playbook_id, edition)) WHERE code IS NOT NULL""")
def _(m):
    return D.document_level(rules(m), filled(m))


@query("rule_counts", """
SELECT playbook_id, edition, count(*) AS rules, count(*) FILTER (len(acceptable) > 0) AS with_acceptable, count(*) FILTER (len(unacceptable) > 0) AS with_unacceptable, count(rule_id) AS with_rule_id,
  count(*) FILTER (dep <> '') AS with_dependencies, count(*) FILTER (len(workflow) > 0) AS with_workflow, count(*) FILTER (required) AS required FROM s_rule GROUP BY 1, 2""")
def _(m):
    return D.rule_counts(rules(m))


def _document_sql() -> str:
    own = ["rule_id_missing", "absence_missing", "deviation_missing", "deviation_unspecified", "prose_gate", "depends_unresolved", "ladder_gap", "precedence_one_sided", "preamble_restates"]
    columns = "playbook_id, edition, {} AS position, {} AS rule, {} AS code, {} AS evidence"
    parts = [f"SELECT {columns.format('position', 'rule', 'code', 'evidence')} FROM ({sql(name)})" for name in own]
    repeats = "SELECT *, lag(name) OVER (PARTITION BY playbook_id, edition, rule_id ORDER BY position) AS other FROM s_rule WHERE rule_id IS NOT NULL"
    parts.append(f"SELECT {columns.format(0, 'name', repr('RULE_ID_DUPLICATE'), 'other')} FROM ({repeats}) WHERE other IS NOT NULL")
    parts.append(f"SELECT {columns.format('position', 'rule', repr('PARENT_CHILD_DUPLICATION'), 'parent')} FROM ({sql('parent_child_duplication')})")
    empty = "''"
    parts.append(f"SELECT {columns.format(0, empty, 'code', empty)} FROM ({sql('document_level')})")
    return " UNION ALL ".join(parts)


@query("document_findings", _document_sql())
def _(m):
    texts = cut(D.akin_texts(akin_runs(m)))
    return D.document_findings(cut(rules(m)), filled(m), texts)


_remedies = ", ".join("('" + k + "', '" + v.replace("'", "''") + "')" for k, v in vocab.REMEDIES.items())


@query("remedy_lookup", f"""
SELECT playbook_id, edition, position, code, r.v AS remedy FROM (SELECT playbook_id, edition, position, unnest([CASE WHEN len(acceptable) = 0 THEN 'NO_ACCEPTABLE_DEVIATION' END, CASE WHEN len(unacceptable) = 0 THEN 'UNACCEPTABLE_NOT_STATED' END]) AS code FROM s_rule)
JOIN (VALUES {_remedies}) r(k, v) ON r.k = code""")
def _(m):
    return D.remedy_lookup(D.deviation_missing(rules(m))).select("playbook_id", "edition", "position", "code", "remedy")


def paired(m, *columns):
    b, a = editions(m, "standard", "acceptable", "unacceptable", "rule_id", *columns)
    return cut(D.pair_rules(b, a)), b, a


@query("pair_rules")
def _(m):
    return paired(m)[0]


@query("diff_counts")
def _(m):
    return D.diff_counts(*paired(m, "guidance", "required"))


@query("rename_findings")
def _(m):
    return D.rename_findings(*paired(m))


@query("reference_broken", """
SELECT playbook_id, position, name, ref AS target FROM s_dep d WHERE edition = 2 AND NOT EXISTS (SELECT 1 FROM s_rule r WHERE r.playbook_id = d.playbook_id AND r.edition = 2 AND r.rule_id = d.ref)""")
def _(m):
    return D.reference_broken(editions(m)[1])


@query("names_gone", """
SELECT DISTINCT playbook_id, lower(name) AS name_key FROM s_rule b WHERE edition = 1 AND NOT EXISTS (SELECT 1 FROM s_rule a WHERE a.edition = 2 AND a.playbook_id = b.playbook_id AND lower(a.name) = lower(b.name))""")
def _(m):
    b, a = editions(m)
    return D.names_gone(b, a)


@query("former_name_mentions")
def _(m):
    return D.former_name_mentions(*paired(m, "guidance", "precedence"))


@query("rule_removed")
def _(m):
    return D.rule_removed(*paired(m, "precedence"))
