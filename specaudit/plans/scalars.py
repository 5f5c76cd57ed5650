"""Queries: one per scalar text function, each over the text or name it applies to."""

from pyspark.sql import functions as F

from specaudit import vocab
from specaudit.functions import normalise as N
from specaudit.functions import text as T
from specaudit.plans.registry import query
from specaudit.sources.views import SQL_VIEWS


def esc(pattern: str) -> str:
    return pattern.replace("'", "''")


def joined(c):
    return F.array_join(c, "|")


_suffix = esc(T.suffix_alternatives())
_dates = "|".join(t.replace(".", r"\.") for t in sorted(vocab.DATE_TOKENS, key=len, reverse=True))
_tokens = f"""list_transform(list_concat(regexp_extract_all(text, '{esc(vocab.BACKTICK)}', 1),
  regexp_extract_all(text, '{esc(vocab.RETURN_PHRASE)}', 1, 'i')), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g'))"""

SQL_VIEWS["s_line"] = r"""
SELECT prompt_version_id, unnest(regexp_split_to_array(text, '\r\n|[\n\v\f\r\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]')) AS line,
       generate_subscripts(regexp_split_to_array(text, '\r\n|[\n\v\f\r\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]'), 1) AS n
FROM {a_prompt_version}"""
# (version, line number, line, token it presents, lower-cased)
SQL_VIEWS["s_presented"] = f"""
SELECT DISTINCT prompt_version_id, n, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS line, lower(regexp_replace(tok, '^\\s+|\\s+$', '', 'g')) AS tok
FROM (SELECT *, unnest(list_concat(regexp_extract_all(line, '{esc(vocab.BACKTICK)}', 1), regexp_extract_all(line, '{esc(vocab.RETURN_PHRASE)}', 1, 'i'))) AS tok FROM {{s_line}})
WHERE NOT regexp_matches(line, '{esc(vocab.NEGATED_LINE)}', 'i')"""


@query("output_tokens", f"SELECT prompt_version_id, array_to_string({_tokens}, '|') AS tokens FROM a_prompt_version")
def _(m):
    return m.a_prompt_version.select("prompt_version_id", joined(T.output_tokens(F.col("text"))).alias("tokens"))


@query("sections", f"""
SELECT prompt_version_id, name, body FROM (
  SELECT prompt_version_id, name, k, body, max(k) OVER (PARTITION BY prompt_version_id, name) AS last_k FROM (
    SELECT prompt_version_id, unnest(list_concat([''], list_transform(regexp_extract_all(text, '(?m){vocab.HEADING_LINE}', 1), lambda x: lower(x)))) AS name,
           unnest(regexp_split_to_array(text, '(?m){vocab.HEADING_LINE}')) AS body,
           generate_subscripts(regexp_split_to_array(text, '(?m){vocab.HEADING_LINE}'), 1) AS k FROM a_prompt_version)) WHERE k = last_k""")
def _(m):
    rows = m.a_prompt_version.select("prompt_version_id", F.inline(T.sections(F.col("text"))))
    return rows.select("prompt_version_id", "name", "body")


@query("positive_term_lines", "SELECT prompt_version_id, string_agg(line, '|' ORDER BY n) AS lines FROM s_presented WHERE tok = 'not stated' GROUP BY 1")
def _(m):
    found = m.a_prompt_version.select("prompt_version_id", T.positive_term_lines(F.col("text"), "Not stated").alias("lines"))
    return found.where(F.size("lines") > 0).withColumn("lines", joined("lines"))


@query("fallback_terms_used", """
SELECT prompt_version_id, string_agg(DISTINCT tok, '|' ORDER BY tok) AS terms FROM s_presented
WHERE tok IN ('not addressed', 'not stated', 'not applicable', 'incorporated terms', 'unable to determine') GROUP BY 1""")
def _(m):
    used = m.a_prompt_version.select("prompt_version_id", T.fallback_terms_used(F.col("text")).alias("terms"))
    return used.where(F.size("terms") > 0).withColumn("terms", joined(F.sort_array(F.transform("terms", F.lower))))


@query("evidence_topk", """
SELECT prompt_version_id, string_agg(line, '|' ORDER BY n) FILTER (rn <= 2) AS lines FROM (
  SELECT *, row_number() OVER (PARTITION BY prompt_version_id ORDER BY n) AS rn FROM s_line WHERE contains(line, '`')) GROUP BY 1""")
def _(m):
    hits = F.filter(T.lines(F.col("text")), lambda ln: F.contains(ln, F.lit("`")))
    return m.a_prompt_version.where("contains(text, '`')").select(
        "prompt_version_id", joined(T.evidence_topk(hits, 2)).alias("lines")
    )


@query("char_count", "SELECT doc_id, length(text) AS char_count FROM documents")
def _(m):
    return m.documents.select("doc_id", T.char_count(F.col("text")).alias("char_count"))


@query("date_pattern_tokens", f"SELECT prompt_version_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '{_dates}'))), '|') AS tokens FROM a_prompt_version")
def _(m):
    return m.a_prompt_version.select("prompt_version_id", joined(F.sort_array(T.date_pattern_tokens(F.col("text")))).alias("tokens"))


SQL_VIEWS["s_money"] = f"""
SELECT prompt_version_id, sample, trim(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(sample, '\\d', '9', 'g'),
   '9[9,]*,[9,]*9', '#', 'g'), '99+', '9999', 'g'), '\\.9+', '.99', 'g'), '#', '9,999')) AS style
FROM (SELECT prompt_version_id, unnest(list_distinct(regexp_extract_all(text, '{vocab.CURRENCY_PATTERN}'))) AS sample FROM {{a_prompt_version}})"""


@query("currency_samples", "SELECT prompt_version_id, sample FROM s_money")
def _(m):
    return m.a_prompt_version.select("prompt_version_id", F.explode(T.currency_samples(F.col("text"))).alias("sample"))


@query("currency_style", "SELECT style, count(*) AS n FROM s_money GROUP BY 1")
def _(m):
    samples = m.a_prompt_version.select(F.explode(T.currency_samples(F.col("text"))).alias("sample"))
    return samples.groupBy(T.currency_style(F.col("sample")).alias("style")).agg(F.count("*").alias("n"))


@query("split_entity", f"""
SELECT name, CASE WHEN b <> '' THEN b ELSE trim(name) END AS base, CASE WHEN b <> '' THEN regexp_extract(trim(name), '^(.*?)[,\\s]+({_suffix})\\.?$', 2) ELSE '' END AS suffix
FROM (SELECT name, trim(regexp_extract(trim(name), '^(.*?)[,\\s]+({_suffix})\\.?$', 1)) AS b FROM (
  SELECT name FROM a_entity UNION ALL SELECT c_name || CASE WHEN c_nationkey % 3 = 0 THEN ' Pty Ltd' WHEN c_nationkey % 3 = 1 THEN ', Inc.' ELSE '' END FROM customer))""")
def _(m):
    made = m.customer.select(F.concat("c_name", F.when(F.col("c_nationkey") % 3 == 0, " Pty Ltd").when(F.col("c_nationkey") % 3 == 1, ", Inc.").otherwise("")).alias("name"))
    return m.a_entity.select("name").unionByName(made).select("name", T.split_entity(F.col("name")).alias("e")).select("name", "e.base", "e.suffix")


_stop = ", ".join(f"'{w}'" for w in vocab.NAME_STOP_WORDS)


@query("name_tokens", f"""
SELECT doc_id, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')), lambda x: x NOT IN ({_stop}))), ' ') AS tokens FROM documents""")
def _(m):
    return m.documents.select("doc_id", F.array_join(F.sort_array(T.name_tokens(F.col("text"))), " ").alias("tokens"))


@query("content_tokens", "SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) > 3))), ' ') AS tokens FROM documents")
def _(m):
    return m.documents.select("doc_id", F.array_join(F.sort_array(T.content_tokens(F.col("text"))), " ").alias("tokens"))


@query("norm_rule_name", """
SELECT conv_id, turn, trim(regexp_replace(lower(translate(text, '’‘“”–—' || chr(160), '''''""-- ')), '\\s+', ' ', 'g')) AS name_key FROM conversations""")
def _(m):
    return m.conversations.select("conv_id", "turn", T.norm_rule_name(F.col("text")).alias("name_key"))


@query("split_label", r"""
SELECT doc_id, CASE WHEN contains(text, chr(10)) THEN nullif(regexp_replace(split_part(text, chr(10), 1), '^\s+|\s+$', '', 'g'), '')
                    WHEN k > 0 THEN regexp_replace(substr(text, 1, k), '^\s+|\s+$', '', 'g') END AS label,
       CASE WHEN contains(text, chr(10)) THEN regexp_replace(substr(text, strpos(text, chr(10)) + 1), '^\s+|\s+$', '', 'g')
            WHEN k > 0 THEN regexp_replace(substr(text, k + 1), '^\s+|\s+$', '', 'g') ELSE regexp_replace(text, '^\s+|\s+$', '', 'g') END AS body
FROM (SELECT doc_id, text, length(regexp_extract(text, '(?s)^(.{2,}?[a-z)\]])[A-Z"“]', 1)) AS k FROM documents)""")
def _(m):
    return m.documents.select("doc_id", T.split_label(F.col("text")).alias("s")).select("doc_id", "s.label", "s.body")


@query("set_hash", """
SELECT l_orderkey, substr(sha256(string_agg(id, chr(10) ORDER BY id)), 1, 16) AS set_hash FROM (SELECT DISTINCT l_orderkey, 'p' || l_partkey AS id FROM lineitem) GROUP BY 1""")
def _(m):
    ids = F.collect_set(F.concat(F.lit("p"), F.col("l_partkey")))
    return m.lineitem.groupBy("l_orderkey").agg(N.set_hash(ids).alias("set_hash"))


@query("slug", "SELECT doc_id, regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM documents")
def _(m):
    return m.documents.select("doc_id", N.slug(F.col("text")).alias("slug"))


@query("count_occurrences", "SELECT doc_id, CAST((length(lower(text)) - length(replace(lower(text), lower(lang), ''))) / length(lang) AS BIGINT) AS n FROM documents")
def _(m):
    return m.documents.select("doc_id", T.count_occurrences(F.col("text"), F.col("lang")).alias("n"))


@query("snapshot_age", """
SELECT event_id, CAST(floor(date_diff('microsecond', ts, TIMESTAMP '2024-01-31 00:00:00') / 1000000) AS BIGINT) AS age_seconds,
       date_diff('microsecond', ts, TIMESTAMP '2024-01-31 00:00:00') < 300000000 AS fresh FROM events""")
def _(m):
    now = F.to_timestamp_ntz(F.lit("2024-01-31 00:00:00"))
    age = F.timestamp_diff("SECOND", F.col("ts"), now)
    return m.events.select("event_id", age.alias("age_seconds"), (age < vocab.OBSERVATION_WINDOW_SECONDS).alias("fresh"))


@query("json_columns", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(m):
    return N.json_columns(m.events, "props", "k bigint").select("event_id", "props.k")


@query("guidance_fields", f"""
WITH g AS (SELECT playbook_id, edition, seq, text FROM a_block WHERE NOT is_heading)
SELECT playbook_id, edition, seq, regexp_replace(nullif(regexp_extract(text, '(?im){vocab.RULE_ID_LINE}', 1), ''), '[.,;]+$', '') AS rule_id,
  coalesce((SELECT string_agg(r || '/' || coalesce(nullif(trim(w), ''), '-'), ' ') FROM (
     SELECT unnest(regexp_extract_all(regexp_extract(text, '(?im){vocab.DEPENDS_LINE}', 1), '{vocab.DEPENDENCY_ITEM}', 1)) AS r,
            unnest(regexp_extract_all(regexp_extract(text, '(?im){vocab.DEPENDS_LINE}', 1), '{vocab.DEPENDENCY_ITEM}', 2)) AS w) WHERE lower(r) NOT IN ('and', 'or')), '') AS depends_on,
  nullif(trim(regexp_extract(text, '(?im){vocab.PRECEDENCE_LINE}', 1)), '') AS precedence,
  nullif(trim(regexp_extract(text, '(?im){vocab.EXHAUSTION_LINE}', 1)), '') AS on_exhaustion,
  nullif(trim(regexp_extract(text, '(?im){vocab.SOURCE_LINE}', 1)), '') AS source,
  nullif(regexp_extract(text, '(?im){vocab.SOURCE_LINE}', 2), '') AS reviewed FROM g""")
def _(m):
    g = m.a_block.where("not is_heading").select("playbook_id", "edition", "seq", T.guidance_fields(F.col("text")).alias("g"))
    depends = F.array_join(F.transform("g.depends_on", lambda d: F.concat(d["ref"], F.lit("/"), F.coalesce(d["reason"], F.lit("-")))), " ")
    return g.select("playbook_id", "edition", "seq", "g.rule_id", depends.alias("depends_on"), "g.precedence", "g.on_exhaustion", "g.source", "g.reviewed")


@query("absence_answered", f"""
SELECT playbook_id, edition, seq, tail <> '' AND (regexp_matches(tail, '{vocab.ABSENCE_ESCALATES}', 'i') OR regexp_matches(tail, '{vocab.ABSENCE_ACCEPTABLE}', 'i')
   OR regexp_matches(tail, '{vocab.OPERATIVE_WORDING}')) AS answered
FROM (SELECT *, regexp_extract(text, '(?is)(({vocab.ABSENCE_CLAUSE}).*)$', 1) AS tail FROM a_block WHERE NOT is_heading)""")
def _(m):
    return m.a_block.where("not is_heading").select("playbook_id", "edition", "seq", T.absence_answered(F.col("text")).alias("answered"))


@query("parse_rule_blocks", r"""
SELECT prompt_version_id, n, regexp_matches(line, '^#{1,6}\s+') AS is_heading,
       CASE WHEN regexp_matches(line, '^#{1,6}\s+') THEN regexp_extract(line, '^#{1,6}\s+(.*)$', 1) ELSE line END AS text FROM s_line""")
def _(m):
    from specaudit.operators.documents import parse_rule_blocks

    blocks = parse_rule_blocks(m.a_prompt_version.select(F.col("prompt_version_id").alias("playbook_id"), "text"))
    return blocks.select(F.col("playbook_id").alias("prompt_version_id"), F.col("seq").alias("n"), "is_heading", "text")
