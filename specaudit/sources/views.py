"""The model tables, derived from the given star-schema and text tables.

Each view is one SELECT that both Spark and any ANSI engine can run, so a result can be
checked against the very same rows. `{name}` marks another view or a given table.

Sizes follow the data: four review tables of twenty columns make one matter, so matters,
tables, columns, prompt versions, runs and results all grow with the input.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

VIEWS: dict[str, str] = {}

VIEWS["a_matter"] = """
SELECT CAST(FLOOR(s_suppkey / 4) AS BIGINT) + 1 AS matter_id,
       'Matter ' || min(s_name) AS name,
       CASE WHEN min(s_nationkey) < 3 THEN 'src' || CAST(min(s_nationkey) AS STRING) END AS project
FROM {supplier} GROUP BY 1"""

VIEWS["a_table"] = """
SELECT s_suppkey + 1 AS table_id,
       CAST(FLOOR(s_suppkey / 4) AS BIGINT) + 1 AS matter_id,
       s_name AS name,
       CASE WHEN s_acctbal >= 0 THEN CAST(s_suppkey % 7 AS INT) END AS position,
       s_suppkey % 3 = 0 AS grouping_enabled,
       CASE WHEN s_acctbal > 2000 THEN 'src' || CAST(s_nationkey AS STRING) END AS project
FROM {supplier}"""

VIEWS["a_column"] = """
SELECT p_partkey + 1 AS column_id,
       CAST(FLOOR(p_partkey / 20) AS BIGINT) + 1 AS table_id,
       p_name || ' ' || p_brand AS name,
       CAST(p_partkey % 20 AS INT) + 1 AS position,
       CASE p_type WHEN 'STANDARD' THEN 'Classify' WHEN 'ECONOMY' THEN 'FreeResponse'
            WHEN 'MEDIUM' THEN 'Date' WHEN 'PROMO' THEN 'Currency'
            WHEN 'LARGE' THEN 'Verbatim' ELSE 'Duration' END AS native_type,
       CASE WHEN p_size <= 5 THEN 'retired' WHEN p_size <= 15 THEN 'draft'
            WHEN p_size <= 30 THEN 'testing' ELSE 'verified' END AS status,
       CASE p_size % 6 WHEN 0 THEN 'orientation' WHEN 1 THEN 'extraction' WHEN 2 THEN 'validation'
            WHEN 3 THEN 'reconciliation' WHEN 4 THEN 'human_review' END AS role,
       CASE WHEN p_size % 4 = 0 THEN p_name END AS concept,
       CASE WHEN p_type <> 'STANDARD' THEN CASE WHEN p_size = 50 THEN 'Yes|No' END
            WHEN p_size % 5 = 0 THEN NULL
            WHEN p_size % 5 = 1 THEN 'Yes|No|yes'
            ELSE 'Yes|No|' || p_brand END AS options
FROM {part}"""

VIEWS["a_dependency"] = """
SELECT table_base + CAST(FLOOR(pos / 2) AS BIGINT) AS src, table_base + pos AS dst,
       'intra_table_ref' AS kind, CAST(NULL AS BIGINT) AS parameter_id
FROM (SELECT p_partkey - p_partkey % 20 AS table_base, p_partkey % 20 + 1 AS pos FROM {part}) a
WHERE pos >= 2
UNION ALL
SELECT p_partkey + 1, p_partkey + 2, 'advisory', CAST(NULL AS BIGINT)
FROM {part} WHERE p_partkey % 80 <> 79 AND p_partkey % 20 = 19 AND p_size > 25
UNION ALL
SELECT p_partkey + 1, p_partkey - p_partkey % 20 + CAST(FLOOR((p_partkey % 20 + 1) / 4) AS BIGINT),
       'advisory', CAST(NULL AS BIGINT)
FROM {part} WHERE p_size = 1 AND p_partkey % 20 >= 3"""

VIEWS["a_prompt_version"] = """
SELECT d.doc_id + 1 AS prompt_version_id, d.column_id, d.minor, d.minor = d.last_minor AS is_current,
       'v1.' || CAST(d.minor AS STRING) AS version, d.created_at, length(d.full_text) AS char_count,
       d.full_text AS text
FROM (
  SELECT v.doc_id, v.column_id, v.created_at,
         row_number() OVER (PARTITION BY v.column_id ORDER BY v.created_at, v.doc_id) - 1 AS minor,
         count(*) OVER (PARTITION BY v.column_id) - 1 AS last_minor,
         v.text || chr(10) || '## Established results' || chr(10) || '- Prior: @'
         || u.p_name || ' ' || u.p_brand || chr(10) || '## Rules' || chr(10)
         || CASE v.doc_id % 7
              WHEN 0 THEN 'Use the established result where the value is given.'
              WHEN 1 THEN 'Apply ' || u.p_name || ' ' || u.p_brand || ' before answering.'
              WHEN 2 THEN 'Return `N/A` when the record is silent.'
              WHEN 3 THEN 'Do not return `None` and never return `Unknown`.'
              WHEN 4 THEN 'The response may use bullets and a numbered list.'
              WHEN 5 THEN 'Keep the answer under 200 characters.'
              ELSE 'State fees as $1,250.00 or 1,250 EUR and dates as DD/MM/YYYY for ' || s.s_name || ' LLC.'
            END || chr(10)
         || CASE WHEN v.doc_id % 11 = 0 THEN '## Closing' ELSE '## Output' END || chr(10)
         || CASE v.doc_id % 6
              WHEN 0 THEN 'Return `Not stated` or `Not addressed` when silent.'
              WHEN 1 THEN 'Return `Yes` or `Maybe`, with Unable to determine — reason if needed.'
              WHEN 2 THEN 'Respond with YYYY-MM-DD.'
              WHEN 3 THEN 'Use markdown. Return exactly "Approved".'
              WHEN 4 THEN 'Return `Not applicable` followed by a brief reason.'
              ELSE 'See @Missing Column for the layout.'
            END AS full_text
  FROM (SELECT doc_id, text, o_orderdate AS created_at,
               (CAST(FLOOR(doc_id / 4) AS BIGINT) * 8 + CAST(FLOOR(doc_id / 4) AS BIGINT) % 8) % (SELECT count(*) FROM {part}) + 1 AS column_id
        FROM {documents} JOIN {orders} ON o_orderkey = doc_id) v
  JOIN {part} p ON p.p_partkey = v.column_id - 1
  JOIN {part} u ON u.p_partkey = CASE v.doc_id % 5
       WHEN 0 THEN v.column_id - 1 - (v.column_id - 1) % 20 + ((v.column_id - 1) % 20 + 1) % 20
       WHEN 1 THEN v.column_id - 1
       ELSE v.column_id - 1 - (v.column_id - 1) % 20 + CAST(FLOOR((v.column_id - 1) % 20 / 2) AS BIGINT) END
  JOIN {supplier} s ON s.s_suppkey = CAST(FLOOR((v.column_id - 1) / 20) AS BIGINT)
) d"""

VIEWS["a_instructions"] = """
SELECT i.conv_id * 100 + i.turn + 1 AS instructions_version_id, i.table_id, i.version,
       i.version = i.last_version AS is_current, i.created_at, i.full_text AS text
FROM (
  SELECT c.conv_id, c.turn, s.s_suppkey + 1 AS table_id, o.o_orderdate AS created_at,
         row_number() OVER (PARTITION BY s.s_suppkey ORDER BY o.o_orderdate, c.conv_id, c.turn) AS version,
         count(*) OVER (PARTITION BY s.s_suppkey) AS last_version,
         c.text || chr(10)
         || CASE c.conv_id % 3
              WHEN 0 THEN 'Allowed states: Not addressed, Not stated, Not applicable, Incorporated terms, Unable to determine.'
              WHEN 1 THEN 'Allowed states: not stated and not applicable.'
              ELSE 'Dates as MM/DD/YYYY or YYYY-MM. Caps near USD 2,000,000.' END
         || chr(10) || 'Subject: ' || s.s_name || CASE WHEN c.turn % 2 = 0 THEN ', LLC.' ELSE ', L.L.C. and others.' END AS full_text
  FROM {conversations} c
  JOIN {supplier} s ON s.s_suppkey = c.conv_id % (SELECT count(*) FROM {supplier})
  JOIN {orders} o ON o.o_orderkey = c.conv_id * 8 + c.turn
) i"""

VIEWS["a_run"] = """
SELECT o_orderkey + 1 AS run_id, CAST(FLOOR(o_custkey / 15) AS BIGINT) + 1 AS table_id,
       o_orderdate AS started_at
FROM {orders}"""

VIEWS["a_eval"] = """
SELECT l.l_orderkey + 1 AS run_id,
       CAST(FLOOR(o.o_custkey / 15) AS BIGINT) * 20 + l.l_partkey % 20 + 1 AS column_id,
       'doc-' || CAST(l.l_suppkey % 10 AS STRING) AS document,
       o.o_orderdate AS started_at,
       CAST(round(l.l_extendedprice * 100) AS BIGINT) * 10 + l.l_linenumber AS result_id,
       l.l_partkey AS result_seq,
       l.l_returnflag <> 'R' AS passed,
       CASE WHEN l.l_returnflag = 'R' OR l.l_quantity = 50 THEN
         CASE l.l_linenumber WHEN 1 THEN 'Scope leakage' WHEN 2 THEN 'scope-leakage'
              WHEN 3 THEN 'Temporal status error' WHEN 4 THEN 'verbosity' WHEN 5 THEN ' '
              WHEN 6 THEN 'Made up/class' ELSE 'Holder/direction error' END END AS raw_class,
       CASE WHEN l.l_returnflag = 'R' THEN CASE WHEN l.l_linestatus = 'F' THEN 'Substantive '
              WHEN l.l_quantity > 40 THEN 'cosmetic' ELSE 'formatting' END END AS raw_error_type,
       CASE WHEN l.l_quantity > 45 THEN 'V1.0' WHEN l.l_quantity > 40 THEN 'v9.9' END AS cited_version
FROM {lineitem} l JOIN {orders} o ON o.o_orderkey = l.l_orderkey"""

VIEWS["a_run_coverage"] = """
SELECT DISTINCT l_orderkey + 1 AS run_id,
       CASE l_partkey % 16 WHEN 0 THEN 'Document Types' WHEN 1 THEN 'single_multi_subject'
         WHEN 2 THEN 'execution-states' WHEN 3 THEN 'amendments_compilations' WHEN 4 THEN 'express'
         WHEN 5 THEN 'silent' WHEN 6 THEN 'incorporated' WHEN 7 THEN 'defective'
         WHEN 8 THEN 'multiple_records' WHEN 9 THEN 'upstream_fallbacks' WHEN 10 THEN 'multi_hop'
         WHEN 11 THEN 'conditional' WHEN 12 THEN 'locked cells' WHEN 13 THEN 'grouped'
         WHEN 14 THEN 'weather' ELSE 'express' END AS raw_dimension
FROM {lineitem}"""

VIEWS["a_assertion"] = """
SELECT c_custkey + 1 AS assertion_id, CAST(FLOOR(c_custkey / 60) AS BIGINT) + 1 AS matter_id,
       c_mktsegment AS section, c_name AS text,
       CASE WHEN c_acctbal < 0 THEN 'judgment' ELSE 'extraction' END AS kind
FROM {customer}"""

VIEWS["a_assertion_source"] = """
SELECT DISTINCT o_custkey + 1 AS assertion_id,
       CAST(FLOOR(o_custkey / 15) AS BIGINT) * 20 + o_orderkey % 20 + 1 AS column_id
FROM {orders}"""

VIEWS["a_parameter"] = """
SELECT s_suppkey + 1 AS parameter_id, CAST(FLOOR(s_suppkey / 4) AS BIGINT) + 1 AS matter_id,
       'Parameter ' || s_name AS name,
       CASE WHEN s_suppkey % 5 <> 4 THEN s_name END AS value,
       CASE WHEN s_suppkey % 5 = 4 THEN 'unresolved' WHEN s_nationkey = 7 THEN 'contested' ELSE 'resolved' END AS status,
       CASE WHEN s_nationkey <> 3 THEN s_suppkey * 20 + s_suppkey % 20 + 1 END AS source_column_id,
       CASE WHEN s_suppkey % 5 <> 4 THEN o_orderdate END AS resolved_at
FROM {supplier} LEFT JOIN {orders} ON o_orderkey = s_suppkey"""

VIEWS["a_binding"] = """
SELECT c_custkey + 1 AS binding_id, t.table_id AS parameter_id,
       t.table_id + CASE WHEN c_custkey % 2 = 1 AND t.table_id % 4 <> 0 AND t.table_id < t.tables THEN 1 ELSE 0 END AS table_id,
       CASE WHEN c_acctbal >= 2000 THEN
         (t.table_id - 1 + CASE WHEN c_custkey % 2 = 1 AND t.table_id % 4 <> 0 AND t.table_id < t.tables THEN 1 ELSE 0 END) * 20
         + c_custkey % 20 + 1 END AS column_id,
       CASE WHEN c_acctbal >= 2000 THEN 'column_prompt' ELSE 'table_instructions' END AS site
FROM (SELECT c_custkey, c_acctbal, CAST(FLOOR(c_custkey / 15) AS BIGINT) + 1 AS table_id, (SELECT count(*) FROM {supplier}) AS tables
      FROM {customer}) t"""

VIEWS["a_standard"] = """
SELECT 'firm' AS scope, CAST(0 AS BIGINT) AS matter_id, CAST(r_regionkey AS BIGINT) + 1 AS version,
       CASE r_regionkey WHEN 0 THEN 'Not addressed|Not stated' WHEN 3 THEN 'Not addressed|Not stated|Not applicable|Incorporated terms|Unable to determine' END AS vocabulary,
       CASE r_regionkey WHEN 1 THEN 'DD/MM/YYYY' WHEN 2 THEN 'YYYY-MM-DD' END AS date_pattern,
       CAST(NULL AS STRING) AS currency_pattern,
       CASE r_regionkey WHEN 0 THEN 'current review unit only' END AS evidence_boundary,
       CASE r_regionkey WHEN 4 THEN 'Title case' END AS naming_rules
FROM {region}
UNION ALL
SELECT 'matter', CAST(FLOOR(s_suppkey / 4) AS BIGINT) + 1, s_suppkey % 4 + 1,
       CASE WHEN s_nationkey = 2 THEN 'Not addressed|Silent' END,
       CASE WHEN s_nationkey < 8 THEN 'YYYY-MM-DD' WHEN s_nationkey < 12 THEN 'MM/DD/YYYY' END,
       CASE WHEN s_nationkey % 5 = 1 THEN '$1,000.00' WHEN s_nationkey % 5 = 2 THEN '1000 EUR' END,
       CASE WHEN s_nationkey % 6 = 1 THEN 'all attachments' END,
       CASE WHEN s_nationkey % 6 = 2 THEN 'Sentence case' END
FROM {supplier}"""

VIEWS["a_entity"] = """
SELECT CAST(FLOOR(s_suppkey / 4) AS BIGINT) + 1 AS matter_id, s_name || ', LLC' AS name
FROM {supplier}"""

VIEWS["a_file"] = """
SELECT source AS project, 'f' || lpad(CAST(d.doc_id AS STRING), 12, '0') AS file_id,
       o_orderdate AS uploaded_at,
       CASE WHEN n_chars >= 200 THEN 'ready_to_query' WHEN n_chars >= 100 THEN 'processing' ELSE 'failed' END AS processing_status,
       CASE WHEN l.toxic = 1 THEN DATE '1999-06-01' END AS deleted_on,
       CAST(FLOOR(d.doc_id / 100) AS BIGINT) AS page
FROM {documents} d JOIN {orders} ON o_orderkey = d.doc_id LEFT JOIN {labels} l ON l.doc_id = d.doc_id"""

VIEWS["a_listing"] = """
SELECT n_nationkey AS listing_id, 'src' || CAST(n_nationkey AS STRING) AS project, n_regionkey <> 4 AS complete
FROM {nation}"""

def repeat(table: str, columns: list[str], rows: list[list[str]], spark: bool) -> str:
    """`table` with each row repeated once per entry of `rows`: one narrow pass in Spark."""
    if spark:
        items = ", ".join(
            "named_struct(" + ", ".join(f"'{c}', {v}" for c, v in zip(columns, row)) + ")"
            for row in rows
        )
        return f"{table} LATERAL VIEW inline(array({items})) b AS {', '.join(columns)}"
    parts = " UNION ALL ".join(
        "SELECT " + ", ".join(f"{v} AS {c}" for c, v in zip(columns, row)) for row in rows
    )
    return f"{table}, LATERAL ({parts}) b"


SPARK_VIEWS: dict[str, str] = {}  # the same rows, in the form Spark runs in one pass

# A text goes out twice, to its order and to its column: what is added to it is looked up per column beforehand.
_prompt = VIEWS["a_prompt_version"]
_prompt = _prompt.replace("u.p_name || ' ' || u.p_brand", "u.prior").replace("s.s_name", "u.s_name")
SPARK_VIEWS["a_prompt_version"] = _prompt[:_prompt.index("  JOIN {part} p ON")] + """  JOIN (
    SELECT t.column_id, collect_list(named_struct('kind', t.kind, 'prior', b.p_name || ' ' || b.p_brand, 's_name', s.s_name)) AS priors
    FROM (SELECT p_partkey + 1 AS column_id, CAST(FLOOR(p_partkey / 20) AS BIGINT) AS place, kind, other
          FROM {part} LATERAL VIEW inline(array(
            named_struct('kind', 0, 'other', p_partkey - p_partkey % 20 + (p_partkey % 20 + 1) % 20),
            named_struct('kind', 1, 'other', p_partkey),
            named_struct('kind', 2, 'other', p_partkey - p_partkey % 20 + CAST(FLOOR(p_partkey % 20 / 2) AS BIGINT)))) o AS kind, other) t
    JOIN {part} b ON b.p_partkey = t.other JOIN {supplier} s ON s.s_suppkey = t.place
    GROUP BY t.column_id) c ON c.column_id = v.column_id
  LATERAL VIEW inline(filter(c.priors, x -> x.kind = CASE v.doc_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END)) u AS kind, prior, s_name
) d"""
# The supplier comes last, so that its join and the window share one exchange of the texts.
_supplier = "  JOIN {supplier} s ON s.s_suppkey = c.conv_id % (SELECT count(*) FROM {supplier})\n"
SPARK_VIEWS["a_instructions"] = VIEWS["a_instructions"].replace(_supplier, "").replace("\n) i", "\n" + _supplier + ") i")

_OBSERVED = [
    ["CAST(1 AS BIGINT)", "DATE '1996-06-01'"],
    ["CAST(2 AS BIGINT)", "DATE '1997-06-01'"],
    ["CAST(3 AS BIGINT)", "DATE '1999-01-01'"],
    ["CAST(4 AS BIGINT)", "DATE '2000-01-01'"],
    ["CAST(5 AS BIGINT)", "DATE '2001-07-20'"],
]


def _members(spark: bool) -> str:
    files = repeat("{a_file} f", ["snapshot_no", "observed_on"], _OBSERVED, spark)
    return f"""
SELECT project, snapshot_no, observed_on, file_id, uploaded_at
FROM {files}
WHERE processing_status = 'ready_to_query' AND CAST(uploaded_at AS DATE) <= observed_on
  AND (deleted_on IS NULL OR deleted_on > observed_on)"""


VIEWS["a_docset_member"] = _members(False)
SPARK_VIEWS["a_docset_member"] = _members(True)

VIEWS["a_requirement"] = """
SELECT c_custkey + 1 AS requirement_id, CAST(FLOOR(c_custkey / 60) AS BIGINT) + 1 AS matter_id,
       'Register ' || CAST(c_custkey % 2 AS STRING) AS source,
       'R-' || CAST(c_custkey AS STRING) AS ref, c_name AS title,
       CASE c_mktsegment WHEN 'FURNITURE' THEN 'served' WHEN 'HOUSEHOLD' THEN 'Synthesis '
            WHEN 'MACHINERY' THEN 'external' WHEN 'BUILDING' THEN 'pending' ELSE 'unassessed' END AS disposition,
       CASE WHEN c_acctbal > 5000 THEN 'outside the record' END AS reason
FROM {customer}"""

VIEWS["a_requirement_link"] = """
SELECT o_orderkey + 1 AS link_id, o_custkey + 1 AS requirement_id,
       CASE o_orderstatus WHEN 'F' THEN 'served_by' WHEN 'O' THEN 'Consumes' ELSE
            CASE WHEN o_totalprice > 490000 THEN 'mentions' ELSE 'produces' END END AS kind,
       CASE WHEN o_orderpriority = '5-LOW' THEN 'Supplier#missing'
            ELSE 'Supplier#' || lpad(CAST(CAST(FLOOR(o_custkey / 15) AS BIGINT) AS STRING), 9, '0') END AS table_name,
       CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'Nowhere' ELSE 'BUILDING' END AS section
FROM {orders}"""

# One to three parts of a requirement, each with a disposition of its own.
VIEWS["a_requirement_part"] = """
SELECT r.requirement_id, r.matter_id, p.n AS part_no, CASE WHEN p.n = 2 THEN ' Second part ' END AS label,
       CASE p.n WHEN 1 THEN r.disposition WHEN 2 THEN 'Served ' ELSE 'external' END AS disposition, CASE WHEN p.n > 1 THEN r.reason END AS reason
FROM {a_requirement} r JOIN (SELECT 1 AS n UNION ALL SELECT 2 UNION ALL SELECT 3) p ON p.n <= 1 + r.requirement_id % 3"""

VIEWS["a_event"] = """
SELECT event_id, event_type AS entity_type, user_id AS entity_id,
       CASE WHEN value < 2 THEN 'create' WHEN value < 8 THEN 'revise' ELSE 'version' END AS action,
       ts AS at, props AS detail
FROM {events}"""

def _rule_lines(edition: int) -> list[list[str]]:
    """The lines of one rule; the second edition renames, renumbers and drops some rules."""
    name = "CASE WHEN p_size % 10 = 9 THEN p_name ELSE p_name || ' ' || p_brand END"
    if edition == 2:
        name = f"CASE WHEN p_size % 10 = 3 THEN 'Revised ' || p_name || ' ' || p_brand ELSE {name} END"
    keep = "TRUE" if edition == 1 else "p_size <> 44"
    rule_id = "CAST(p_size AS STRING) || '.' || CAST(rule_no AS STRING)"
    if edition == 2:
        rule_id = f"CASE WHEN p_size % 10 = 7 THEN 'x.' || CAST(rule_no AS STRING) ELSE {rule_id} END"
    lines = [
        ("TRUE", name, "TRUE"),
        ("TRUE", "'Standard position'", "TRUE"),
        ("FALSE", "p_type || ' terms apply to ' || p_name || '.'", "TRUE"),
        ("FALSE", "coalesce(body, 'See ' || p_brand || ' for the agreed position.')", "p_size % 9 <> 8"),
        ("FALSE", "CASE p_size % 4 WHEN 0 THEN 'If not present, escalate to the steward.' "
                  "WHEN 1 THEN 'If missing: insert the following.' "
                  "WHEN 2 THEN 'If the clause is absent, insert the following: \"The parties agree that every term above shall apply in full.\"' END", "p_size % 4 <> 3"),
        ("TRUE", "'Acceptable deviations'", "p_size % 8 <> 1"),
        ("FALSE", "CASE p_size % 3 WHEN 0 THEN 'Accept reasonable edits.' "
                  "WHEN 1 THEN 'A term of up to 3 years.' ELSE 'Notice of 30 days for ' || p_brand || '.' END", "p_size % 8 <> 1"),
        ("FALSE", "'A cap of $25,000 on ' || p_type || '.'", "p_size % 7 = 2"),
        ("TRUE", "'Unacceptable deviations:'", "p_size % 8 <> 5"),
        ("FALSE", "CASE p_size % 2 WHEN 0 THEN 'An indefinite term.' ELSE 'More than 10 years.' END", "p_size % 8 <> 5"),
        ("TRUE", "'Guidance'", "TRUE"),
        ("FALSE", f"'Rule ID: ' || {rule_id} || '.'", "p_size % 6 <> 5"),
        ("FALSE", "'Depends on: ' || CAST(p_size AS STRING) || '.' || CAST(rule_no AS STRING) || ' (ordering) and 99.' || CAST(rule_no AS STRING)", "p_size % 5 = 0"),
        ("FALSE", "'Precedence: prevails over ' || p_name || ' Brand#1 and ' || p_name || ' Brand#2.'", "p_size % 5 = 1"),
        ("FALSE", "'On exhaustion: escalate.'", "p_size = 50"),
        ("FALSE", "'Source: Manual of ' || p_type || ' · Reviewed: 2021-05-0' || CAST(p_size % 9 + 1 AS STRING)", "p_size % 3 = 1"),
        ("FALSE", "'Note: ' || p_name || ' ' || p_brand || ' was agreed earlier.'", "p_size % 5 = 3"),
        ("FALSE", "'This rule applies only when ' || p_brand || ' is party.'", "p_size % 11 = 4"),
        ("TRUE", "'Required'", "p_size % 3 <> 2"),
        ("FALSE", "CASE WHEN p_size % 3 = 0 THEN 'Yes' ELSE 'No' END", "p_size % 3 <> 2"),
    ]
    return [
        [str(k), heading, f"CASE WHEN {keep} AND {when} THEN {text} END"]
        for k, (heading, text, when) in enumerate(lines)
    ]


_FRONT_LINES = [
    ["0", "TRUE", "'Document control'"],
    ["1", "FALSE", "CASE WHEN s_nationkey % 2 = 0 THEN 'Owner: ' || s_name ELSE 'Issued for ' || s_name END"],
    ["3", "TRUE", "'Preamble'"],
    ["4", "FALSE", "CASE WHEN s_nationkey % 3 = 0 THEN 'On exhaustion of a fallback, stop.' ELSE 'General remarks.' END"],
    ["5", "FALSE", "'For small ring Brand#2 notice of 30 days and standard economy terms apply to small ring.'"],
]


def _edition(edition: int, spark: bool) -> str:
    columns = ["k", "is_heading", "line"]
    rules = repeat("r", columns, _rule_lines(edition), spark)
    front = repeat("{supplier} s", columns, _FRONT_LINES, spark)
    return f"""
SELECT table_id AS playbook_id, {edition} AS edition, rule_no * 20 + k AS seq, is_heading, line AS text
FROM (SELECT * FROM (
  SELECT CAST(FLOOR(p_partkey / 20) AS BIGINT) + 1 AS table_id, CAST(p_partkey % 20 AS BIGINT) + 1 AS rule_no,
         p_name, p_brand, p_type, p_size, d.text AS body
  FROM {{part}} LEFT JOIN {{documents}} d ON d.doc_id * 2 = p_partkey) {rules}) x
WHERE line IS NOT NULL
UNION ALL
SELECT s_suppkey + 1, {edition}, CAST(k AS BIGINT), is_heading, line FROM {front}"""


VIEWS["a_block"] = f"{_edition(1, False)}\nUNION ALL\n{_edition(2, False)}"
SPARK_VIEWS["a_block"] = f"{_edition(1, True)}\nUNION ALL\n{_edition(2, True)}"

_NAME = re.compile(r"\{([a-z]\w*)\}")


SQL_VIEWS: dict[str, str] = {}  # shared fragments of the plain-SQL equivalents; Spark never reads them


def needs(name: str) -> list[str]:
    text = VIEWS[name] if name in VIEWS else SQL_VIEWS[name]
    return list(dict.fromkeys(_NAME.findall(text)))


class Model:
    """The model tables of one data folder, built lazily and only once per name."""

    def __init__(self, spark: SparkSession, folder: str, given: dict[str, DataFrame] | None = None):
        self.spark, self.folder = spark, folder
        self._built: dict[str, DataFrame] = dict(given or {})

    def once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A derived table that several parts of one query read: built the first time it is asked for."""
        if name not in self._built:
            self._built[name] = build()
        return self._built[name]

    def keep(self, name: str, table: DataFrame) -> None:
        """From now on this is the table of that name, for what is built later."""
        self._built[name] = table

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._built:
            if name in VIEWS:
                parts = {dep: getattr(self, dep) for dep in needs(name)}
                self._built[name] = self.spark.sql(SPARK_VIEWS.get(name, VIEWS[name]), **parts)
            elif name in BASE_TABLES:
                self._built[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            else:
                raise AttributeError(name)
        return self._built[name]


def with_views(sql: str) -> str:
    """Prefix a query with the view definitions it uses, for an engine that has the given tables."""
    known = VIEWS | SQL_VIEWS
    order: list[str] = []

    def add(name: str) -> None:
        if name in order:
            return
        for dep in needs(name):
            if dep in known:
                add(dep)
        order.append(name)

    for name in known:
        if re.search(rf"\b{name}\b", sql):
            add(name)
    if not order:
        return sql
    body = ",\n".join(f"{n} AS ({_NAME.sub(lambda m: m.group(1), known[n])}\n)" for n in order)
    stripped = sql.lstrip()
    if stripped.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {body},\n{stripped[len('WITH RECURSIVE'):]}"
    if stripped.upper().startswith("WITH"):
        return f"WITH {body},\n{stripped[len('WITH'):]}"
    return f"WITH {body}\n{stripped}"
