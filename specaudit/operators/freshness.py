"""Document sets: observations, differences between them, and whether a table's set has moved.

A set is held as rows (project, snapshot, file), never as one array, so a project with most of
the files is just many rows. Its digest is a sum of hashed parts and combines before a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specaudit.functions.normalise import fingerprint


def record_docset(members: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Snapshots from observed files; a bare count is used only where no file was listed."""
    keys = ["project", "snapshot_no", "observed_on"]
    seen = members.groupBy(*keys).agg(
        F.count("*").alias("listed"),
        F.max(F.to_date("uploaded_at")).alias("latest_upload"),
        fingerprint(F.col("file_id")).alias("set_print"),
    )
    if counts is None:
        return seen.withColumnRenamed("listed", "ready_count")
    both = seen.join(counts, keys, "full")
    return both.select(*keys, F.coalesce("listed", "count").alias("ready_count"), "latest_upload", "set_print").where(
        "ready_count is not null"
    )


def ready_file_inventory(files: DataFrame, listings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(snapshot per completely listed project, projects whose listing stopped early).

    A prefix of a listing is not the set, so an incomplete one is reported and never recorded.
    """
    ready = files.where("processing_status = 'ready_to_query' and deleted_on is null")
    per = ready.groupBy("project").agg(
        F.count("*").alias("ready_count"),
        F.max(F.to_date("uploaded_at")).alias("latest_upload"),
        fingerprint(F.col("file_id")).alias("set_print"),
    )
    status = listings.groupBy("project").agg(F.bool_and("complete").alias("complete"))
    joined = per.join(status, "project")
    return (
        joined.where("complete").drop("complete"),
        joined.where(~F.col("complete")).select("project", F.col("ready_count").alias("documents_seen")),
    )


def _moved(before: Column, after: Column) -> Column:
    """(delta, later_upload, moved) between two snapshot structs; null when there is nothing to compare."""
    delta = after["ready_count"] - before["ready_count"]
    later = F.coalesce(after["latest_upload"] > before["latest_upload"], F.lit(False))
    prints = before["set_print"].isNotNull() & after["set_print"].isNotNull()
    differs = F.coalesce(before["set_print"] != after["set_print"], F.lit(False))
    return F.struct(
        delta.alias("ready_delta"), later.alias("later_upload"),
        F.when(prints, "set").otherwise("count").alias("basis"),
        ((delta != 0) | later | differs).alias("moved"),
    )


def snapshot_diff(pairs: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Compare the two snapshots named by each row of `pairs` (project, before_no, after_no)."""
    s = F.struct("ready_count", "latest_upload", "set_print")
    b = snapshots.select("project", F.col("snapshot_no").alias("before_no"), s.alias("b"))
    a = snapshots.select("project", F.col("snapshot_no").alias("after_no"), s.alias("a"))
    both = pairs.join(b, ["project", "before_no"], "left").join(a, ["project", "after_no"], "left")
    comparable = F.col("a").isNotNull() & F.col("b").isNotNull()
    d = _moved(F.col("b"), F.col("a"))
    return both.select(
        "project", "before_no", "after_no", comparable.alias("comparable"), F.when(comparable, d).alias("d")
    ).select("project", "before_no", "after_no", "comparable", "d.*")


def previous_snapshot_diff(snapshots: DataFrame, members: DataFrame) -> DataFrame:
    """Each snapshot against the one before it, with files added and removed.

    A file's presence is compared with its own presence in the neighbouring snapshot numbers, so the
    work is one aggregate over membership rows and no snapshot is gathered whole.
    """
    w = Window.partitionBy("project").orderBy("observed_on", "snapshot_no")
    s = F.struct("ready_count", "latest_upload", "set_print")
    ordered = snapshots.select(
        "project", "snapshot_no", "observed_on", F.lag("snapshot_no").over(w).alias("before_no"),
        F.lead("snapshot_no").over(w).alias("after_no"), s.alias("a"), F.lag(s).over(w).alias("b"),
    ).where("before_no is not null or after_no is not null")
    d = _moved(F.col("b"), F.col("a"))
    diffs = ordered.where("before_no is not null").select("project", "snapshot_no", "before_no", d.alias("d")).select(
        "project", "snapshot_no", "before_no", "d.*"
    )
    order = ordered.select("project", "snapshot_no", "before_no", "after_no")
    marked = members.join(order, ["project", "snapshot_no"])
    now = marked.where("before_no is not null").select("project", "file_id", F.col("snapshot_no").alias("at_no"), F.lit(1).alias("here"))
    then = marked.where("after_no is not null").select("project", "file_id", F.col("after_no").alias("at_no"), F.lit(2).alias("here"))
    change = (
        now.unionByName(then).groupBy("project", "at_no", "file_id").agg(F.sum("here").alias("here"))
        .groupBy("project", F.col("at_no").alias("snapshot_no"))
        .agg(F.count_if(F.col("here") == 1).alias("added"), F.count_if(F.col("here") == 2).alias("removed"))
    )
    return diffs.join(change, ["project", "snapshot_no"], "left").fillna(0, ["added", "removed"])


def table_projects(tables: DataFrame, matters: DataFrame) -> DataFrame:
    """A table's own project, else its matter's."""
    m = matters.select("matter_id", F.col("project").alias("matter_project"))
    return tables.join(m, "matter_id", "left").select(
        "matter_id", "table_id", F.coalesce("project", "matter_project").alias("project")
    )


def snapshot_asof(runs: DataFrame, projects: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The snapshot each run is pinned to: the latest one observed by the time it was recorded.

    Snapshots become validity intervals, so every run meets one row of its project.
    """
    w = Window.partitionBy("project").orderBy("observed_on", "snapshot_no")
    valid = snapshots.select(
        F.col("project").alias("s_project"), "snapshot_no", "observed_on", F.lead("observed_on").over(w).alias("until")
    )
    on = F.to_date("started_at")
    placed = runs.join(projects.where("project is not null").select("table_id", "project"), "table_id")
    return placed.join(
        valid,
        (F.col("project") == F.col("s_project")) & (F.col("observed_on") <= on)
        & (F.col("until").isNull() | (on < F.col("until"))),
    ).select("run_id", "table_id", "project", "snapshot_no")


def docset_freshness(
    projects: DataFrame, snapshots: DataFrame, latest_runs: DataFrame, pinned: DataFrame
) -> DataFrame:
    """unobserved / never_run / unrecorded / current / moved for every table."""
    s = F.struct("observed_on", "snapshot_no", "ready_count", "latest_upload", "set_print")
    current = snapshots.groupBy("project").agg(F.max(s).alias("a"))
    then = snapshots.select("project", "snapshot_no", s.alias("b"))
    ran = latest_runs.select("table_id", "run_id").join(
        pinned.select("run_id", "snapshot_no", "project").join(then, ["project", "snapshot_no"]).select("run_id", "b"),
        "run_id", "left",
    )
    both = projects.join(current, "project", "left").join(ran, "table_id", "left")
    d = _moved(F.col("b"), F.col("a"))
    state = (
        F.when(F.col("a").isNull(), "unobserved").when(F.col("run_id").isNull(), "never_run")
        .when(F.col("b").isNull(), "unrecorded").when(d["moved"], "moved").otherwise("current")
    )
    delta = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), d["ready_delta"])
    return both.select("matter_id", "table_id", "project", "run_id", state.alias("state"), delta.alias("ready_delta"))


def freshness_findings(fresh: DataFrame) -> DataFrame:
    code = (
        F.when(F.col("state") == "moved", "DOCSET_MOVED").when(F.col("state") == "unrecorded", "DOCSET_UNRECORDED")
        .when((F.col("state") == "unobserved") & F.col("project").isNotNull(), "DOCSET_UNOBSERVED")
        .when(F.col("state") == "unobserved", "DOCSET_NO_PROJECT")
    )
    return fresh.withColumn("code", code).where("code is not null").select("matter_id", "table_id", "project", "code")


def docset_state_counts(fresh: DataFrame) -> DataFrame:
    return fresh.groupBy("matter_id", "state").agg(F.count("*").alias("n"))
