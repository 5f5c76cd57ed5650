"""Readers for submitted batches. Schemas are declared, so a read never scans a file to guess one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SUBMISSION = (
    "table_id bigint, seq bigint, name string, position int, native_type string, status string, role string, concept string, "
    "options array<string>, prompt_text string, upstream_refs array<string>, "
    "advisory_upstream array<struct<table:string,column:string,note:string>>, _corrupt_record string"
)
EVAL_LOG = (
    "run_id bigint, column_id bigint, test_document string, passed boolean, prompt_version string, actual_answer string, "
    "evidence_relied_on string, expected_behavior string, failure_class string, error_type string, revision_note string, "
    "rerun_scope string, result_after_rerun string, regressions string"
)


def read_submission(spark: SparkSession, path: str) -> DataFrame:
    """Column records as JSON lines. Loose labels stay strings; a record that does not parse is kept aside."""
    return spark.read.schema(SUBMISSION).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def read_eval_log(spark: SparkSession, path: str, kind: str = "csv") -> DataFrame:
    if kind == "json":
        return spark.read.schema(EVAL_LOG).json(path)
    return spark.read.schema(EVAL_LOG).option("header", "true").option("multiLine", "false").csv(path)
