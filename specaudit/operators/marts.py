"""Wide summaries: one row per column, per table and per matter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specaudit import vocab

_STATES = ["never_run", "current", "direct", "transitive"]


def status_counts(columns: DataFrame) -> DataFrame:
    return columns.groupBy("table_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in vocab.COLUMN_STATUSES])


def column_profile(
    vertices: DataFrame, prompts: DataFrame, edges: DataFrame, targets: DataFrame, parameters: DataFrame,
    states: DataFrame, summary: DataFrame,
) -> DataFrame:
    """Per column: its current version, neighbours, parameters, staleness and evaluation summary.

    Neighbours are counts; the edge table itself lists them, so a hub does not become one huge row.
    """
    up = edges.groupBy(F.col("dst").alias("column_id")).agg(F.countDistinct("src").alias("upstream"))
    down = edges.groupBy(F.col("src").alias("column_id")).agg(F.countDistinct("dst").alias("downstream"))
    consumed = targets.groupBy("column_id").agg(F.countDistinct("parameter_id").alias("consumes"))
    sourced = parameters.groupBy(F.col("source_column_id").alias("column_id")).agg(F.count("*").alias("feeds"))
    row = vertices.select("column_id", "table_id", "matter_id", "status", "native_type")
    for part in (
        prompts.select("column_id", "version", "char_count"), up, down, consumed, sourced,
        states.select("column_id", "state"), summary.select("column_id", "runs", "open_failures"),
    ):
        row = row.join(part, "column_id", "left")
    return row.fillna(0, ["upstream", "downstream", "consumes", "feeds"])


def matter_overview(
    tables: DataFrame, columns: DataFrame, states: DataFrame, failures: DataFrame, unticked: DataFrame, fresh: DataFrame,
) -> DataFrame:
    """Per table and, with a null table, per matter: columns, staleness, failures, gaps, document sets."""
    live = columns.where("status <> 'retired'").select("table_id", "column_id")
    per_column = failures.groupBy("column_id").agg(F.count("*").alias("n"))
    mix = live.join(states.select("column_id", "state"), "column_id", "left").join(per_column, "column_id", "left").groupBy("table_id").agg(
        F.count("*").alias("columns"), *[F.count_if(F.col("state") == s).alias(s) for s in _STATES], F.sum("n").alias("open_failures"))
    gaps = unticked.groupBy("table_id").agg(F.count("*").alias("unticked"))
    moved = fresh.select("table_id", (F.col("state") == "moved").cast("int").alias("moved"))
    base = tables.select("matter_id", "table_id").join(mix, "table_id", "left").join(gaps, "table_id", "left").join(moved, "table_id", "left")
    measures = ["columns", *_STATES, "open_failures", "unticked", "moved"]
    return base.rollup("matter_id", "table_id").agg(*[F.coalesce(F.sum(x), F.lit(0)).cast("bigint").alias(x) for x in measures]).where("matter_id is not null")


def export_counts(parts: dict[str, DataFrame]) -> DataFrame:
    """Rows per matter and measure. Each part has matter_id; the parts are counted before they meet."""
    counted = [df.groupBy("matter_id").agg(F.count("*").alias("n")).withColumn("measure", F.lit(name)) for name, df in parts.items()]
    out = counted[0]
    for more in counted[1:]:
        out = out.unionByName(more)
    return out.groupBy("matter_id").pivot("measure", list(parts)).agg(F.sum("n")).fillna(0)
