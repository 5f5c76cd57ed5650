"""Queries: references and prompt rules, over every prompt version."""

from pyspark.sql import functions as F

from specaudit import vocab
from specaudit.operators import graph as G
from specaudit.operators import lint as L
from specaudit.operators.references import find_refs, referenced_names
from specaudit.plans.registry import query, sql
from specaudit.plans.scalars import esc
from specaudit.session import cut
from specaudit.sources.views import SQL_VIEWS

_stop = ", ".join(f"'{w}'" for w in vocab.REFERENCE_STOP_WORDS)
_fallback = ", ".join(f"'{v.lower()}'" for v in vocab.FALLBACK_VOCABULARY)
_typed = ", ".join(f"'{v}'" for v in vocab.TYPED_COLUMNS)

SQL_VIEWS["s_prompt"] = """
SELECT p.prompt_version_id AS text_id, p.column_id, c.table_id, c.name, c.position, c.native_type, c.options, p.text FROM {a_prompt_version} p JOIN {a_column} c USING (column_id)"""
SQL_VIEWS["s_at"] = r"""
SELECT text_id, table_id, k AS at_no, substr(text, k + 1, (SELECT max(length(name)) + 1 FROM {a_column})) AS win, substr(text, k + 1) AS rest FROM (
  SELECT text_id, table_id, text, parts, i, CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) AS BIGINT) + i AS k FROM (
    SELECT *, unnest(range(1, len(parts))) AS i FROM (SELECT text_id, table_id, text, string_split(text, '@') AS parts FROM {s_prompt} WHERE contains(text, '@'))))
WHERE regexp_matches(parts[i + 1], '^[A-Za-z\[]') AND NOT regexp_matches(parts[i], '[\pL\pN_.]$') AND NOT (i > 1 AND parts[i] = '')"""
SQL_VIEWS["s_ref"] = rf"""
WITH best AS (SELECT a.text_id, a.at_no, arg_max(c.name, (length(c.name), -c.position, -c.column_id)) AS resolved_name, arg_max(c.column_id, (length(c.name), -c.position, -c.column_id)) AS resolved_id
  FROM {{s_at}} a JOIN {{a_column}} c ON c.table_id = a.table_id AND starts_with(lower(a.win), lower(c.name)) AND NOT regexp_matches(substr(a.win, length(c.name) + 1, 1), '[\pL\pN_]') GROUP BY 1, 2),
w AS (SELECT a.*, list_filter(regexp_split_to_array(regexp_extract(rest, '^[^\n`,.;:()\[\]"'']*'), '\s+'), lambda x: x <> '') AS words FROM {{s_at}} a),
g AS (SELECT *, coalesce(list_position(list_transform(words[2:6], lambda x: lower(x) IN ({_stop})), TRUE), 0) AS stop FROM w)
SELECT g.text_id, g.table_id, g.at_no AS start_at, CASE WHEN b.resolved_name IS NOT NULL THEN substr(g.win, 1, length(b.resolved_name))
   ELSE array_to_string(words[1:CASE WHEN stop = 0 THEN 6 ELSE stop END], ' ') END AS raw, b.resolved_id, b.resolved_name
FROM g LEFT JOIN best b ON b.text_id = g.text_id AND b.at_no = g.at_no
WHERE b.resolved_name IS NOT NULL OR len(words) > 0"""
SQL_VIEWS["s_ctx"] = """
SELECT r.*, p.column_id, p.name AS own_name, p.position AS own_position FROM {s_ref} r JOIN {s_prompt} p USING (text_id)"""
SQL_VIEWS["s_section"] = f"""
SELECT text_id, name, body, k FROM (
  SELECT *, max(k) OVER (PARTITION BY text_id, name) AS last_k FROM (
    SELECT text_id, unnest(list_concat([''], list_transform(regexp_extract_all(text, '(?m){vocab.HEADING_LINE}', 1), lambda x: lower(x)))) AS name,
           unnest(regexp_split_to_array(text, '(?m){vocab.HEADING_LINE}')) AS body,
           generate_subscripts(regexp_split_to_array(text, '(?m){vocab.HEADING_LINE}'), 1) AS k FROM {{s_prompt}})) WHERE k = last_k"""


def prompts(m):
    return L.prompt_rows(m.a_prompt_version, m.a_column)


def refs(m):
    return find_refs(prompts(m).select("text_id", "table_id", "text"), m.a_column)


@query("find_refs", "SELECT text_id, table_id, start_at, raw, resolved_id, resolved_name FROM s_ref")
def _(m):
    return refs(m)


@query("referenced_names", """
SELECT text_id, coalesce(string_agg(resolved_name, '|' ORDER BY start_at) FILTER (resolved_name IS NOT NULL), '') AS resolved, coalesce(string_agg(raw, '|' ORDER BY start_at) FILTER (resolved_name IS NULL), '') AS unresolved
FROM (SELECT text_id, resolved_name, CASE WHEN resolved_name IS NULL THEN raw END AS raw, min(start_at) AS start_at FROM s_ref GROUP BY 1, 2, 3) GROUP BY 1""")
def _(m):
    out = referenced_names(refs(m))
    return out.select("text_id", F.array_join("resolved", "|").alias("resolved"), F.array_join("unresolved", "|").alias("unresolved"))


@query("build_ref_edges", """
SELECT DISTINCT resolved_id AS src, column_id AS dst, 'intra_table_ref' AS kind FROM (
  SELECT x.resolved_id, x.column_id FROM s_ctx x JOIN a_prompt_version v ON v.prompt_version_id = x.text_id AND v.is_current WHERE resolved_id IS NOT NULL
  UNION SELECT src, dst FROM a_dependency WHERE kind = 'intra_table_ref') WHERE resolved_id <> column_id""")
def _(m):
    current = L.prompt_rows(m.a_prompt_version.where("is_current"), m.a_column)
    found = find_refs(current.select("text_id", "table_id", "text"), m.a_column).join(current.select("text_id", "column_id"), "text_id")
    declared = m.a_dependency.where("kind = 'intra_table_ref'").select(F.col("dst").alias("column_id"), F.col("src").alias("upstream_id"))
    return G.build_ref_edges(found.select("column_id", F.col("resolved_id").alias("upstream_id")), declared)


@query("lint_length", """
SELECT text_id, column_id, CASE WHEN length(text) > 10000 THEN 'PROMPT_LENGTH_HARD' ELSE 'PROMPT_LENGTH_ADVISORY' END AS code, CAST(length(text) AS VARCHAR) AS evidence FROM s_prompt WHERE length(text) > 6000""")
def _(m):
    return L.lint_length(prompts(m))


def _term_sql(code: str, terms: list[str], where: str, label: bool) -> str:
    low = ", ".join(f"('{t}', '{t.lower()}')" for t in terms)
    text = "string_agg(line, '|' ORDER BY n)"
    return f"""
SELECT text_id, column_id, '{code}' AS code, {"t || ': ' || " if label else ""}{text} AS evidence FROM (
  SELECT p.text_id, p.column_id, v.t, s.line, s.n, row_number() OVER (PARTITION BY p.text_id, v.t ORDER BY s.n) AS rn
  FROM s_prompt p JOIN s_presented s ON s.prompt_version_id = p.text_id JOIN (VALUES {low}) v(t, k) ON v.k = s.tok WHERE {where}) GROUP BY text_id, column_id, t"""


@query("lint_synonym", _term_sql("FALLBACK_SYNONYM", vocab.FALLBACK_SYNONYMS, "TRUE", True))
def _(m):
    return L.lint_synonym(prompts(m))


@query("lint_not_stated", _term_sql("FALLBACK_NOT_STATED_UNTYPED", ["Not stated"], f"p.native_type NOT IN ({_typed})", False))
def _(m):
    return L.lint_not_stated(prompts(m))


@query("lint_not_addressed", _term_sql("FALLBACK_NOT_ADDRESSED_TYPED", ["Not addressed"], f"p.native_type IN ({_typed})", False))
def _(m):
    return L.lint_not_addressed(prompts(m))


@query("lint_label_not_configured", f"""
WITH t AS (SELECT text_id, column_id, table_id, options, unnest(toks) AS tok, generate_subscripts(toks, 1) AS i FROM (SELECT *, list_transform(list_concat(
    regexp_extract_all(text, '{esc(vocab.BACKTICK)}', 1), regexp_extract_all(text, '{esc(vocab.RETURN_PHRASE)}', 1, 'i')),
    lambda x: regexp_replace(regexp_replace(x, '^\\s+|\\s+$', '', 'g'), '^[“”"'']+|[“”"'']+$', '', 'g')) AS toks FROM s_prompt WHERE native_type = 'Classify')),
k AS (SELECT text_id, column_id, tok, min(i) AS i FROM t WHERE tok <> '' AND NOT contains(tok, '@') AND lower(tok) NOT IN ({_fallback}) AND NOT list_contains(string_split(lower(coalesce(options, '')), '|'), lower(tok))
  AND regexp_matches(tok, '^\\p{{Lu}}') AND length(tok) <= 60 AND NOT EXISTS (SELECT 1 FROM a_column c WHERE c.table_id = t.table_id AND lower(c.name) = lower(tok)) GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY i) AS rn FROM k)
SELECT text_id, column_id, 'CLASSIFY_LABEL_NOT_CONFIGURED' AS code, string_agg(tok, '|' ORDER BY i) AS evidence FROM r GROUP BY 1, 2""")
def _(m):
    return L.lint_label_not_configured(prompts(m), m.a_column)


@query("lint_qualifier", f"""
SELECT text_id, column_id, 'CLASSIFY_QUALIFIER_PERMITTED' AS code, e AS evidence FROM (
  SELECT text_id, column_id, coalesce(nullif(regexp_extract(text, '{vocab.EM_DASH_QUALIFIER}', 0, 'i'), ''), nullif(regexp_extract(text, '{vocab.QUALIFIER_PHRASE}', 0, 'i'), '')) AS e
  FROM s_prompt WHERE native_type = 'Classify') WHERE e IS NOT NULL""")
def _(m):
    return L.lint_qualifier(prompts(m))


@query("lint_options_missing", "SELECT text_id, column_id, 'OPTIONS_MISSING' AS code, '' AS evidence FROM s_prompt WHERE native_type = 'Classify' AND options IS NULL")
def _(m):
    return L.lint_options_missing(prompts(m))


@query("lint_ref_self", "SELECT DISTINCT text_id, column_id, 'REF_SELF' AS code, resolved_name AS evidence FROM s_ctx WHERE lower(resolved_name) = lower(own_name)")
def _(m):
    return L.lint_ref_self(prompts(m), refs(m))


@query("lint_ref_unresolved", "SELECT DISTINCT text_id, column_id, 'REF_UNRESOLVED' AS code, raw AS evidence FROM s_ctx WHERE resolved_name IS NULL")
def _(m):
    return L.lint_ref_unresolved(prompts(m), refs(m))


@query("lint_ref_forward", """
SELECT DISTINCT text_id, x.column_id, 'REF_FORWARD' AS code, resolved_name AS evidence FROM s_ctx x
JOIN (SELECT table_id, lower(name) AS k, arg_max(position, column_id) AS p FROM a_column GROUP BY 1, 2) c ON c.table_id = x.table_id AND c.k = lower(x.resolved_name)
WHERE lower(resolved_name) <> lower(own_name) AND c.p > own_position""")
def _(m):
    return L.lint_ref_forward(prompts(m), refs(m), m.a_column)


@query("lint_output_contract", f"""
SELECT text_id, column_id, 'OUTPUT_CONTRACT_MISSING' AS code, '' AS evidence FROM s_prompt
WHERE NOT regexp_matches(text, '(?im){vocab.OUTPUT_HEADING}') AND NOT regexp_matches(text, '(?i){vocab.RETURN_WORD}')""")
def _(m):
    return L.lint_output_contract(prompts(m))


@query("lint_markdown", f"""
WITH o AS (SELECT text_id, string_agg(body, chr(10) ORDER BY k) AS body FROM s_section WHERE regexp_matches(name, '(?i){vocab.OUTPUT_SECTION}') GROUP BY 1),
ln AS (SELECT text_id, k, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS n FROM s_section WHERE NOT regexp_matches(name, '(?i){vocab.OUTPUT_SECTION}')),
h AS (SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY k, n) AS rn FROM ln WHERE regexp_matches(line, '(?i){esc(vocab.MARKDOWN_TERMS)}') AND NOT regexp_matches(line, '(?i){esc(vocab.NEGATED_LINE)}')
  AND NOT regexp_matches(line, '(?i){vocab.PLAIN_TEXT}') AND regexp_matches(line, '(?i){vocab.ANSWER_LINE}'))
SELECT p.text_id, p.column_id, 'MARKDOWN_IN_CELL' AS code, string_agg(trim(h.line), '|' ORDER BY h.rn) AS evidence
FROM h JOIN s_prompt p USING (text_id) LEFT JOIN o USING (text_id)
WHERE NOT (regexp_matches(coalesce(o.body, ''), '(?i){vocab.MARKDOWN_ALLOW}') AND NOT regexp_matches(coalesce(o.body, ''), '(?i){vocab.PLAIN_TEXT}')) GROUP BY 1, 2""")
def _(m):
    return L.lint_markdown(prompts(m))


@query("lint_character_rule", f"""
SELECT text_id, column_id, 'CHARACTER_COUNT_RULE' AS code, string_agg(line, '|' ORDER BY n) AS evidence FROM (
  SELECT p.text_id, p.column_id, l.n, trim(l.line) AS line, row_number() OVER (PARTITION BY p.text_id ORDER BY l.n) AS rn FROM s_prompt p JOIN s_line l ON l.prompt_version_id = p.text_id
  WHERE regexp_matches(l.line, '(?i){vocab.CHARACTER_COUNT}') AND NOT regexp_matches(l.line, '(?i){esc(vocab.NEGATED_LINE)}')) GROUP BY 1, 2""")
def _(m):
    return L.lint_character_rule(prompts(m))


@query("lint_dead_reference", f"""
WITH b AS (SELECT text_id, string_agg(line, chr(10) ORDER BY k, n) AS used FROM (
    SELECT text_id, k, unnest(list_concat([name], string_split(body, chr(10)))) AS line, generate_subscripts(list_concat([name], string_split(body, chr(10))), 1) AS n
    FROM s_section WHERE NOT regexp_matches(name, '(?i){vocab.ESTABLISHED_HEADING}')) WHERE NOT regexp_matches(line, '{vocab.DECLARATION_LINE}') GROUP BY 1)
SELECT DISTINCT x.text_id, x.column_id, 'DEAD_REFERENCE' AS code, x.resolved_name AS evidence FROM s_ctx x JOIN b USING (text_id)
WHERE x.resolved_name IS NOT NULL AND lower(x.resolved_name) <> lower(x.own_name) AND NOT regexp_matches(b.used, '(?i){vocab.GENERIC_UPSTREAM_USE}')
  AND NOT regexp_matches(b.used, '(?i)(^|[^\\w])' || regexp_escape(x.resolved_name) || '($|[^\\w])')""")
def _(m):
    return L.lint_dead_reference(prompts(m), refs(m))


_REF_RULES = ["lint_ref_self", "lint_ref_unresolved", "lint_ref_forward"]
_TEXT_RULES = [
    "lint_length", "lint_synonym", "lint_not_stated", "lint_not_addressed", "lint_label_not_configured", "lint_qualifier", "lint_options_missing",
    "lint_output_contract", "lint_markdown", "lint_character_rule", "lint_dead_reference",
]
_NOW = "text_id IN (SELECT prompt_version_id FROM a_prompt_version v JOIN a_column c USING (column_id) WHERE v.is_current AND c.status <> 'retired')"


def _union_sql(rules: list[str], where: str = "TRUE") -> str:
    return " UNION ALL ".join(f"SELECT text_id, column_id, code, evidence FROM ({sql(r)}) WHERE {where}" for r in rules)


@query("lint_prompts", _union_sql(_TEXT_RULES + _REF_RULES))
def _(m):
    # texts are read by every rule, names and references by several: each is worked out once
    m.keep("a_column", cut(m.a_column))
    texts = cut(prompts(m))
    return L.lint_prompts(texts, m.a_column, cut(find_refs(texts.select("text_id", "table_id", "text"), m.a_column)))


def live_prompts(m):
    """The current prompts of active columns: what findings are about."""
    return L.prompt_rows(m.a_prompt_version.where("is_current"), m.a_column.where("status <> 'retired'"))


def live_refs(m):
    return m.once("live_refs", lambda: cut(find_refs(live_prompts(m).select("text_id", "table_id", "text"), m.a_column)))


@query("prompt_findings", _union_sql(_TEXT_RULES, _NOW))
def _(m):
    rows = live_prompts(m)
    return L.lint_row_rules(rows).unionByName(L.lint_label_not_configured(rows, m.a_column)).unionByName(L.lint_dead_reference(rows, live_refs(m)))


@query("reference_findings", _union_sql(_REF_RULES, _NOW))
def _(m):
    return L.lint_references(live_prompts(m), m.a_column, live_refs(m))


SCAN_RULES = [
    ("email", r"[\w.]+@[\w.]+\.\w+", None),
    ("license", r"\b(license|licence|copyright)\b", r"\bno license\b"),
    ("digits", r"\b\d{5,}\b", None),
    ("question", r"\?\s*$", r"\b(que|la|le)\b"),
]


@query("text_rule_scan", r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
h AS (SELECT doc_id, n, line, unnest([CASE WHEN regexp_matches(line, '(?i)[\pL\pN_.]+@[\pL\pN_.]+\.[\pL\pN_]+') THEN 'email' END,
  CASE WHEN regexp_matches(line, '(?i)\b(license|licence|copyright)\b') AND NOT regexp_matches(line, '(?i)\bno license\b') THEN 'license' END,
  CASE WHEN regexp_matches(line, '\b\d{5,}\b') THEN 'digits' END,
  CASE WHEN regexp_matches(line, '\?\s*$') AND NOT regexp_matches(line, '(?i)(^|[^\pL\pN_])(que|la|le)($|[^\pL\pN_])') THEN 'question' END]) AS rule_id FROM l)
SELECT doc_id, rule_id, string_agg(trim(line), '|' ORDER BY n) AS lines, count(*) AS n_lines FROM h WHERE rule_id IS NOT NULL GROUP BY 1, 2""")
def _(m):
    return L.text_rule_scan(m.documents, SCAN_RULES).withColumn("lines", F.array_join("lines", "|"))
