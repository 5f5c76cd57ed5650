"""Audits of shared parameters and their bindings, for every matter at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def param_orphaned(parameters: DataFrame, bindings: DataFrame) -> DataFrame:
    return parameters.join(bindings, "parameter_id", "left_anti").select("matter_id", "parameter_id", "status")


def param_unresolved_consumed(parameters: DataFrame, bindings: DataFrame) -> DataFrame:
    """Unresolved parameters that something consumes, per consuming table."""
    per = bindings.groupBy("parameter_id", "table_id").agg(F.count("*").alias("bindings"))
    return parameters.where("status <> 'resolved'").join(per, "parameter_id").select(
        "matter_id", "parameter_id", "table_id", "status", "bindings"
    )


def param_source_retired(parameters: DataFrame, columns: DataFrame) -> DataFrame:
    retired = columns.where("status = 'retired'").select(F.col("column_id").alias("source_column_id"))
    return parameters.join(retired, "source_column_id").select("matter_id", "parameter_id", "source_column_id")


def binding_dangling(bindings: DataFrame, columns: DataFrame) -> DataFrame:
    retired = columns.where("status = 'retired'").select("column_id")
    return bindings.join(retired, "column_id").select("binding_id", "parameter_id", "column_id")


def param_not_in_instructions(bindings: DataFrame) -> DataFrame:
    sites = bindings.groupBy("parameter_id", "table_id").agg(
        F.bool_or(F.col("site") == "table_instructions").alias("in_instructions")
    )
    return sites.where(~F.col("in_instructions")).select("parameter_id", "table_id")


def param_value_absent(
    parameters: DataFrame, bindings: DataFrame, instructions: DataFrame, prompts: DataFrame
) -> DataFrame:
    """Bound sites whose current text lacks the resolved value; a site without text lacks it too.

    `instructions`: table_id, version, text. `prompts`: column_id, version, text. Current ones only.
    """
    bound = bindings.join(parameters.where(F.length("value") > 0).select("parameter_id", "value"), "parameter_id")

    def lacking(sites: DataFrame, texts: DataFrame, key: str, code: str) -> DataFrame:
        t = texts.select(key, F.col("version").cast("string").alias("version"), "text")
        has = F.coalesce(F.contains(F.lower("text"), F.lower("value")), F.lit(False))
        return sites.join(t, key, "left").where(~has).select(
            "binding_id", "parameter_id", "table_id", "column_id", F.lit(code).alias("code"), "version"
        )

    rules = lacking(
        bound.where("site = 'table_instructions'"), instructions, "table_id", "PARAM_VALUE_ABSENT_FROM_INSTRUCTIONS"
    )
    texts = lacking(
        bound.where("site <> 'table_instructions' and column_id is not null"), prompts, "column_id",
        "PARAM_VALUE_ABSENT_FROM_PROMPT",
    )
    return rules.unionByName(texts)


def parameter_mart(parameters: DataFrame, bindings: DataFrame, columns: DataFrame) -> DataFrame:
    consumers = bindings.groupBy("parameter_id").agg(F.count("*").alias("consumers"))
    source = columns.select(
        F.col("column_id").alias("source_column_id"), F.col("status").alias("source_status")
    )
    return (
        parameters.join(consumers, "parameter_id", "left").join(source, "source_column_id", "left")
        .select("parameter_id", "matter_id", "value", "status", "source_column_id", "source_status",
                F.coalesce("consumers", F.lit(0)).alias("consumers"), "resolved_at")
    )
