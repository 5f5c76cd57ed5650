"""The append-only logs as streams.

Each job runs over whatever has arrived (`availableNow`) and keeps its progress and state in the
shared folder, so a restart continues where the last run stopped. Results are written as tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from specaudit import vocab
from specaudit.operators.versioning import merge_columns
from specaudit.session import is_written, new_folder  # noqa: F401  (for callers of the jobs)


def file_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """A table of the folder as a stream of files, with the schema the table already has."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def _drain(stream: DataFrame, mode: str, folder: str, write: Callable[[DataFrame, int], None]) -> None:
    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True).foreachBatch(write).start()
    )
    query.awaitTermination()


def _write_batch(folder: str) -> Callable[[DataFrame, int], None]:
    """One folder per batch, overwritten on replay, so a repeated batch changes nothing."""
    def write(df: DataFrame, batch: int) -> None:
        df.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{folder}/rows/batch_no={batch}")

    return write


def _written(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/rows").drop("batch_no")


def stream_latest_results(log: DataFrame, folder: str) -> DataFrame:
    """The latest result per (column, document), kept by a streaming max in log order.

    An older row that arrives late never replaces a newer one, whatever order files come in.
    """
    order = F.struct("started_at", "run_id", "result_id", "result_seq", "passed", "failure_class")
    latest = log.groupBy("column_id", "document").agg(F.max(order).alias("r"))
    _drain(latest, "update", folder, _write_batch(folder))
    rows = _written(log.sparkSession, folder)
    return rows.groupBy("column_id", "document").agg(F.max_by("r", "batch").alias("r")).select("column_id", "document", "r.*")


def stream_open_failures(log: DataFrame, folder: str) -> DataFrame:
    return stream_latest_results(log, folder).where(~F.col("passed"))


def stream_activity(events: DataFrame, folder: str, window: str = "1 day") -> DataFrame:
    """Event counts per type, action and window.

    Each batch leaves its own counts, which are added up on reading; so an event counts whenever it comes, and no state
    is kept.
    """
    keys = ["window", "entity_type", "action"]

    def write(batch: DataFrame, number: int) -> None:
        counts = batch.groupBy(F.window("at", window), "entity_type", "action").agg(F.count("*").alias("n"))
        counts.write.mode("overwrite").parquet(f"{folder}/rows/batch_no={number}")

    _drain(events, "append", folder, write)
    rows = _written(events.sparkSession, folder)
    return rows.groupBy(*keys).agg(F.sum("n").alias("n")).select(F.col("window.start").alias("starts"), "entity_type", "action", "n")


def stream_docset_moved(snapshots: DataFrame, folder: str) -> DataFrame:
    """A row whenever a project's observed set differs from the one observed before it.

    Observations are stored as they arrive and compared in order of observation on reading, so one that comes late takes
    its place between its neighbours.
    """
    columns = ["project", "observed_on", "snapshot_no", "ready_count", "latest_upload", "set_print"]
    _drain(snapshots.select(*columns), "append", folder, _write_batch(folder))
    order = Window.partitionBy("project").orderBy("observed_on", "snapshot_no")
    before = {f"p_{c}": F.lag(c).over(order) for c in columns[2:]}
    row = _written(snapshots.sparkSession, folder).withColumns(before).where("p_snapshot_no is not null")
    moved = (F.col("ready_count") != F.col("p_ready_count")) | (F.col("latest_upload") > F.col("p_latest_upload")) | (F.col("set_print") != F.col("p_set_print"))
    return row.where(moved).select("project", F.col("p_snapshot_no").alias("before_no"), "snapshot_no", (F.col("ready_count") - F.col("p_ready_count")).alias("ready_delta"))


def _kept(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    last = state.get[0] if state.exists else None
    rows = pd.concat(list(frames)).sort_values(["at_ms", "event_id"])
    keep = []
    for at_ms, event_id in zip(rows["at_ms"], rows["event_id"]):
        if last is None or at_ms - last >= vocab.OBSERVATION_WINDOW_SECONDS * 1000:
            keep.append((key[0], event_id, at_ms))
            last = at_ms
    if last is not None:
        state.update((last,))
    yield pd.DataFrame(keep, columns=["project", "event_id", "at_ms"])


def stream_poll_suppress(observations: DataFrame, folder: str) -> DataFrame:
    """At most one observation per project and window, counted from the last one that was kept."""
    kept = observations.groupBy("project").applyInPandasWithState(
        _kept, "project string, event_id long, at_ms long", "last long", "append", "NoTimeout")
    _drain(kept, "append", folder, _write_batch(folder))
    return _written(observations.sparkSession, folder).drop("batch")


def stream_ingest(submissions: DataFrame, stored: DataFrame, folder: str) -> DataFrame:
    """Submissions merged batch by batch into the stored columns.

    The state after each batch is a table of its own, numbered as the batch; the one before the first is written only if
    it is not there. So a run on the same folder goes on where the last one stopped, and a repeated batch repeats its result.
    """
    spark = submissions.sparkSession
    if not is_written(spark, f"{folder}/state/-1"):
        stored.write.mode("overwrite").parquet(f"{folder}/state/-1")

    def merge(batch: DataFrame, number: int) -> None:
        before = spark.read.parquet(f"{folder}/state/{number - 1}")
        last = batch.groupBy("table_id", "name").agg(F.max(F.struct("seq", "position", "native_type", "status", "role", "text")).alias("r"))
        merged = merge_columns(before, last.select("table_id", "name", "r.*").drop("seq"))
        merged.select(*before.columns).write.mode("overwrite").parquet(f"{folder}/state/{number}")

    _drain(submissions, "append", folder, merge)
    number = -1
    while is_written(spark, f"{folder}/state/{number + 1}"):
        number += 1
    return spark.read.parquet(f"{folder}/state/{number}")
