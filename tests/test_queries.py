"""Named queries against their plain-SQL equivalents, on the smallest given tables.

SPECAUDIT_ALL=1 runs every query; by default a quick cross-section runs.
"""

import os

import pytest
from compare import compare, connect

from specaudit.plans import all_builders, all_oracles

FOLDER = "/root/testdata/sf0.001"
QUICK = [
    "latest_results", "failures_summary", "run_compare", "regressions", "validate_eval", "dimension_gaps", "binding_targets",
    "text_sites", "columns_find", "activity_feed", "param_value_absent", "docset_freshness", "previous_snapshot_diff",
    "register_findings", "downstream_closure", "staleness", "find_refs", "lint_markdown", "lint_dead_reference",
    "entity_variants", "concept_divergent_rules", "parse_rules", "ladder_gap", "merge_columns", "effective_standard", "import_export",
    "matter_overview", "near_duplicate_texts",
]
NAMES = list(all_oracles()) if os.environ.get("SPECAUDIT_ALL") else QUICK


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    state, detail = compare(spark, con, FOLDER, name, all_builders(), all_oracles())
    assert state == "ok", detail


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
