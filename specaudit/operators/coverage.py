"""How well assertions are supported by the columns they draw on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def source_reliability(
    vertices: DataFrame, sources: DataFrame, summary: DataFrame, states: DataFrame,
    unticked: DataFrame, fresh: DataFrame,
) -> DataFrame:
    """Every sourced column with the reasons it cannot be relied on; none means it can."""
    gaps = unticked.groupBy("table_id").agg(F.count("*").alias("n_unticked"))
    moved = fresh.where("state = 'moved'").select("table_id", F.lit(True).alias("docset_moved"))
    row = (
        vertices.join(sources, "column_id", "left_semi").select("column_id", "table_id", "matter_id", "status")
        .join(summary.select("column_id", "runs", "open_failures"), "column_id", "left")
        .join(states.select("column_id", "state"), "column_id", "left")
        .join(gaps, "table_id", "left").join(moved, "table_id", "left")
    )
    c = F.col
    tests = {
        "retired": c("status") == "retired",
        "no run": F.coalesce(c("runs"), F.lit(0)) == 0,
        "open failures": c("open_failures") > 0,
        "stale": c("state").isin("direct", "transitive"),
        "unticked dimensions": c("n_unticked") > 0,
        "document set moved": c("docset_moved"),
    }
    reasons = F.array_compact(F.array(*[F.when(t, F.lit(name)) for name, t in tests.items()]))
    return row.select("column_id", "table_id", "matter_id", "status", (F.size(reasons) == 0).alias("reliable"), reasons.alias("reasons"))


def assertion_coverage(assertions: DataFrame, sources: DataFrame, reliability: DataFrame) -> DataFrame:
    per = sources.join(reliability.select("column_id", "status", "reliable"), "column_id").groupBy("assertion_id").agg(
        F.count("*").alias("sources"),
        F.count_if(F.col("status") != "retired").alias("active"),
        F.count_if((F.col("status") != "retired") & F.col("reliable")).alias("reliable"),
    )
    status = (
        F.when(F.col("kind") == "judgment", "judgment_boundary")
        .when(F.coalesce("active", F.lit(0)) == 0, "extraction_gap")
        .when(F.col("reliable") > 0, "reliably_covered").otherwise("nominally_covered")
    )
    retired = (F.col("kind") != "judgment") & (F.coalesce("sources", F.lit(0)) > F.coalesce("active", F.lit(0)))
    return assertions.join(per, "assertion_id", "left").select(
        "matter_id", "assertion_id", "section", "kind", status.alias("status"),
        F.coalesce("sources", F.lit(0)).alias("sources"), retired.alias("has_retired_source"),
    )


def coverage_totals(covered: DataFrame) -> DataFrame:
    def n(status: str):
        return F.count_if(F.col("status") == status).alias(status)

    return covered.groupBy("matter_id").agg(
        F.count("*").alias("assertions"), n("reliably_covered"), n("nominally_covered"),
        n("extraction_gap"), n("judgment_boundary"),
    )


def coverage_findings(covered: DataFrame) -> DataFrame:
    code = (
        F.when(F.col("status") == "judgment_boundary", "COV_JUDGMENT_BOUNDARY")
        .when(F.col("status") == "extraction_gap", "COV_EXTRACTION_GAP")
        .when(F.col("status") == "nominally_covered", "COV_NOMINAL_ONLY")
    )
    codes = F.array_compact(F.array(code, F.when(F.col("has_retired_source"), F.lit("COV_SOURCE_RETIRED"))))
    return covered.select("matter_id", "assertion_id", "section", F.explode(codes).alias("code"))


def reverse_coverage(affected: DataFrame, sources: DataFrame, columns: DataFrame) -> DataFrame:
    """Assertions at risk per subject: unsupported when every active source is hit, else weakened.

    `affected`: subject, column_id. Only assertions that a hit source reaches are expanded, and the
    number of active sources of an assertion is counted once for all subjects.
    """
    active = sources.join(columns.where("status <> 'retired'").select("column_id"), "column_id").select("assertion_id", "column_id")
    totals = active.groupBy("assertion_id").agg(F.count("*").alias("active"))
    hit = affected.select("subject", "column_id").distinct().join(active, "column_id")
    per = hit.groupBy("subject", "assertion_id").agg(F.count("*").alias("hit"))
    return per.join(totals, "assertion_id").select(
        "subject", "assertion_id", "hit", "active",
        F.when(F.col("hit") == F.col("active"), "unsupported").otherwise("weakened").alias("status"),
    )


def outline_version(submitted: DataFrame, previous: DataFrame, vertices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(assertion sources resolved by name, sources that match no column).

    `submitted`: matter_id, section, assertion, kind, sources array<struct<table,column>>.
    `previous`: matter_id, version of the outline it replaces.
    """
    from specaudit.functions.normalise import norm_name

    flat = submitted.select("matter_id", "section", "assertion", "kind", F.explode_outer("sources").alias("s"))
    known = vertices.select(
        "matter_id", norm_name(F.col("table_name")).alias("t_key"), norm_name(F.col("name")).alias("c_key"), "column_id"
    ).groupBy("matter_id", "t_key", "c_key").agg(F.min("column_id").alias("column_id"))
    keyed = flat.withColumns({"t_key": norm_name(F.col("s.table")), "c_key": norm_name(F.col("s.column"))})
    joined = keyed.join(known, ["matter_id", "t_key", "c_key"], "left").join(
        previous.select("matter_id", "version"), "matter_id", "left"
    ).withColumn("version", F.coalesce(F.col("version") + 1, F.lit(1)))
    outline = joined.where("s is null or column_id is not null").select(
        "matter_id", "version", "section", "assertion", "kind", "column_id"
    ).distinct()
    missing = joined.where("s is not null and column_id is null").select(
        "matter_id", "section", "assertion", F.col("s.table").alias("table_name"), F.col("s.column").alias("column_name")
    )
    return outline, missing
