"""Which columns no longer reflect what they were run with, directly or through what they read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specaudit.operators.graph import _union, positions, rerun_order
from specaudit.session import cut


def staleness_direct(
    columns: DataFrame, last_runs: DataFrame, versions: DataFrame, instructions: DataFrame,
    bindings: DataFrame, parameters: DataFrame,
) -> DataFrame:
    """never_run / direct / current for every active column, with the reasons.

    `versions` and `instructions` are the current ones. A parameter counts when it was resolved after
    the run; only its latest resolution per site matters, so bindings shrink to one time per site.
    """
    resolved = bindings.join(parameters.where("resolved_at is not null").select("parameter_id", "resolved_at"), "parameter_id")
    by_column = resolved.where("column_id is not null").groupBy("table_id", "column_id").agg(F.max("resolved_at").alias("c_resolved"))
    by_table = resolved.where("column_id is null").groupBy("table_id").agg(F.max("resolved_at").alias("t_resolved"))
    now_prompt = versions.select("column_id", F.col("prompt_version_id").alias("now_prompt"))
    now_rules = instructions.select("table_id", F.col("instructions_version_id").alias("now_rules"))
    row = (
        columns.where("status <> 'retired'").select("column_id", "table_id")
        .join(last_runs, "column_id", "left").join(now_prompt, "column_id", "left")
        .join(now_rules, "table_id", "left").join(by_column, ["table_id", "column_id"], "left")
        .join(by_table, "table_id", "left")
    )
    c = F.col
    late = F.coalesce(F.greatest("c_resolved", "t_resolved") > c("started_at"), F.lit(False))
    tests = {
        "prompt version changed": c("now_prompt") != c("prompt_version_id"),
        "table instructions changed": c("now_rules").isNotNull()
        & (c("instructions_version_id").isNull() | (c("now_rules") != c("instructions_version_id"))),
        "shared parameter resolved": late,
    }
    reasons = F.array_compact(F.array(*[F.when(t, F.lit(name)) for name, t in tests.items()]))
    ran = c("run_id").isNotNull()
    state = F.when(~ran, "never_run").when(F.size(reasons) > 0, "direct").otherwise("current")
    return row.select(
        "column_id", "table_id", state.alias("state"),
        F.when(ran, reasons).otherwise(F.array().cast("array<string>")).alias("reasons"), "run_id", "started_at",
    )


def staleness(direct: DataFrame, edges: DataFrame, versions: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Add `transitive`: a current column that reads something stale or changed since its own run.

    Within one run the pinned version is compared exactly; otherwise the upstream's current version
    must be newer than the reader's run. Staleness then spreads through current columns only; a
    column that never ran neither becomes stale nor passes it on.
    """
    base = cut(direct.select("column_id", "state", "run_id", "started_at"))
    pinned = snapshots.select("run_id", F.col("column_id").alias("src"), F.col("prompt_version_id").alias("pin"))
    now = versions.select(F.col("column_id").alias("src"), F.col("prompt_version_id").alias("now"), "created_at")
    up = base.select(F.col("column_id").alias("src"), F.col("state").alias("up_state"))
    # only current columns can turn transitive, and only edges between live columns can do it
    reads = cut(
        edges.select("src", "dst").distinct()
        .join(base.where("state = 'current'").select(F.col("column_id").alias("dst"), "run_id", "started_at"), "dst")
        .join(up, "src")
    )
    changed = (
        reads.where("up_state not in ('direct')").join(now, "src").join(pinned, ["run_id", "src"], "left")
        .where(F.when(F.col("pin").isNotNull(), F.col("pin") != F.col("now")).otherwise(F.col("created_at") > F.col("started_at")))
        .select("dst")
    )
    seeds = reads.where("up_state = 'direct'").select("dst").unionByName(changed).distinct()
    spread = [cut(seeds.select(F.col("dst").alias("column_id")))]
    while True:
        hit = reads.join(spread[-1].withColumnRenamed("column_id", "src"), "src", "left_semi").select(F.col("dst").alias("column_id")).distinct()
        fresh = cut(hit.join(_union(spread), "column_id", "left_anti"))
        if fresh.isEmpty():
            break
        spread.append(fresh)
    stale = _union(spread).withColumn("reached", F.lit(True))
    return direct.join(stale, "column_id", "left").select(
        "column_id", "table_id", F.when(F.col("reached"), "transitive").otherwise(F.col("state")).alias("state"),
        F.when(F.col("reached"), F.array(F.lit("upstream stale or changed"))).otherwise(F.col("reasons")).alias("reasons"),
        "run_id", "started_at",
    )


def staleness_reasons(states: DataFrame, edges: DataFrame, versions: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(column_id, reason, upstream_id, kind, upstream_state, upstream_version), one row per cause of a stale column.

    A direct cause is the column's own and names no upstream. A transitive one names the edge: its upstream is stale, or
    has a prompt other than the one pinned in the reader's run (newer than the run, where the run pins none).
    """
    none = lambda kind: F.lit(None).cast(kind)
    own = states.where("state = 'direct'").select(
        "column_id", F.explode("reasons").alias("reason"), none("bigint").alias("upstream_id"), none("string").alias("kind"),
        none("string").alias("upstream_state"), none("string").alias("upstream_version"))
    reader = states.where("state = 'transitive'").select(F.col("column_id").alias("dst"), "run_id", "started_at")
    up = states.select(F.col("column_id").alias("src"), F.col("state").alias("upstream_state"))
    now = versions.select(F.col("column_id").alias("src"), F.col("prompt_version_id").alias("now"), F.col("version").alias("upstream_version"), "created_at")
    pinned = snapshots.select("run_id", F.col("column_id").alias("src"), F.col("prompt_version_id").alias("pin"))
    row = edges.select("src", "dst", "kind").distinct().join(reader, "dst").join(up, "src").join(now, "src", "left").join(pinned, ["run_id", "src"], "left")
    changed = F.when(F.col("pin").isNotNull(), F.col("pin") != F.col("now")).otherwise(F.col("created_at") > F.col("started_at"))
    causes = F.array_compact(F.array(
        F.when(F.col("upstream_state").isin("direct", "transitive"), F.lit("upstream stale")), F.when(changed, F.lit("upstream changed"))))
    return own.unionByName(row.select(
        F.col("dst").alias("column_id"), F.explode(causes).alias("reason"), F.col("src").alias("upstream_id"), "kind", "upstream_state", "upstream_version"))


def staleness_report(states: DataFrame, tables: DataFrame) -> DataFrame:
    per = states.join(tables.select("table_id", "matter_id"), "table_id")
    return per.groupBy("matter_id").agg(
        *[F.count_if(F.col("state") == s).alias(s) for s in ("never_run", "current", "direct", "transitive")]
    )


def stale_rerun_order(states: DataFrame, edges: DataFrame, tables: DataFrame, vertices: DataFrame) -> DataFrame:
    """(matter_id, table_id, column_id, state, seq): the stale columns of each matter in the order in which to rerun them."""
    stale = states.where("state in ('direct', 'transitive')").select("column_id", "table_id", "state").join(tables.select("table_id", "matter_id"), "table_id")
    place = stale.select(F.col("matter_id").alias("root"), F.col("column_id").alias("node")).join(positions(vertices), "node")
    order = rerun_order(edges, place).select(F.col("node").alias("column_id"), "seq")
    return stale.join(order, "column_id").select("matter_id", "table_id", "column_id", "state", "seq")


def lifecycle_findings(columns: DataFrame, states: DataFrame) -> DataFrame:
    row = columns.where("status <> 'retired'").select("column_id", "table_id", "status").join(
        states.select("column_id", "state"), "column_id", "left")
    codes = F.array_compact(F.array(
        F.when(F.col("status").isin("draft", "testing"), F.lit("COLUMN_NOT_VERIFIED")),
        F.when(F.col("state").isin("direct", "transitive"), F.lit("COLUMN_STALE")),
        F.when(F.col("state") == "never_run", F.lit("COLUMN_NEVER_RUN")),
    ))
    return row.select("table_id", "column_id", F.explode(codes).alias("code"))
