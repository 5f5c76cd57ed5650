"""Queries: the logs followed as streams. Each drains what has arrived and returns the written result."""

from pyspark.sql import functions as F

from specaudit import vocab
from specaudit.plans.audits import snaps
from specaudit.plans.evaluation import log
from specaudit.plans.ingest import accepted, stored
from specaudit.plans.registry import query
from specaudit.sources.views import Model
from specaudit.streaming import jobs as J


def live(m, table: str) -> Model:
    """The same model with one given table arriving as a stream of files."""
    return Model(m.spark, m.folder, {table: J.file_stream(m.spark, m.folder, f"{table}.parquet")})


def replay(m, df, files_per_batch: int):
    """Derived rows written once, then read back as a stream of files."""
    folder = J.new_folder(m.spark)
    df.write.parquet(f"{folder}/in")
    schema = m.spark.read.parquet(f"{folder}/in").schema
    return m.spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{folder}/in")


def since_epoch(unit: str):
    return F.timestamp_diff(unit, F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), F.col("at"))


@query("stream_open_failures", "SELECT column_id, document, run_id, failure_class FROM s_latest WHERE NOT passed")
def _(m):
    rows = J.stream_open_failures(log(live(m, "lineitem")), J.new_folder(m.spark))
    return rows.select("column_id", "document", "run_id", "failure_class")


@query("stream_activity", """
SELECT CAST(CAST(e."at" AS DATE) AS VARCHAR) AS starts, e.entity_type, e.action, count(*) AS n FROM a_event e GROUP BY 1, 2, 3""")
def _(m):
    # event times carry no zone: they are counted from the epoch, whatever the session's zone is
    events = live(m, "events").a_event.withColumn("at", F.timestamp_micros(since_epoch("MICROSECOND")))
    rows = J.stream_activity(events, J.new_folder(m.spark))
    day = F.date_from_unix_date(F.floor(F.unix_seconds("starts") / 86400).cast("int"))
    return rows.withColumn("starts", day.cast("string"))


@query("stream_docset_moved", """
WITH o AS (SELECT *, lag(snapshot_no) OVER w AS before_no, lag(ready_count) OVER w AS pc, lag(latest_upload) OVER w AS pu, lag(set_print) OVER w AS pp FROM s_snap WINDOW w AS (PARTITION BY project ORDER BY observed_on, snapshot_no))
SELECT project, before_no, snapshot_no, ready_count - pc AS ready_delta FROM o WHERE before_no IS NOT NULL AND (ready_count <> pc OR latest_upload > pu OR set_print <> pp)""")
def _(m):
    return J.stream_docset_moved(replay(m, snaps(m), 1000), J.new_folder(m.spark))


@query("stream_poll_suppress", f"""
WITH RECURSIVE e AS (SELECT 'user' || entity_id AS project, event_id, epoch_us("at") // 1000 AS at_ms FROM a_event),
k(project, at_ms) AS (SELECT project, min(at_ms) FROM e GROUP BY 1
  UNION ALL SELECT k.project, (SELECT min(e.at_ms) FROM e WHERE e.project = k.project AND e.at_ms >= k.at_ms + {vocab.OBSERVATION_WINDOW_SECONDS * 1000}) FROM k WHERE k.at_ms IS NOT NULL)
SELECT k.project, min(e.event_id) AS event_id, k.at_ms FROM k JOIN e ON e.project = k.project AND e.at_ms = k.at_ms GROUP BY 1, 3""")
def _(m):
    events = live(m, "events").a_event.select(
        F.concat(F.lit("user"), F.col("entity_id")).alias("project"), "event_id",
        since_epoch("MILLISECOND").alias("at_ms"))
    return J.stream_poll_suppress(events, J.new_folder(m.spark))


@query("stream_ingest", "SELECT table_id, name_key AS name, minor, status, action <> 'created' AS had_key FROM s_merged")
def _(m):
    batches = accepted(m).repartitionByRange(4, "seq")
    rows = J.stream_ingest(replay(m, batches, 1), stored(m), J.new_folder(m.spark))
    return rows.select("table_id", F.lower("name").alias("name"), "minor", "status", F.col("column_id").isNotNull().alias("had_key"))
