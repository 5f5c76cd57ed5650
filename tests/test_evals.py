import datetime as dt

from specaudit.operators import evals as E
from specaudit.streaming import jobs as J

SCHEMA = "run_id long, column_id long, document string, started_at timestamp_ntz, result_id long, result_seq long, passed boolean, raw_class string, raw_error_type string"


def log_row(run, day, doc, passed, result=1, column=1):
    return (run, column, doc, dt.datetime(2024, 1, day), result, 0, passed, None if passed else "verbosity", None)


def test_failure_closes_and_late_rows_do_not_reopen(spark):
    rows = [log_row(1, 1, "a", False), log_row(1, 1, "b", False), log_row(2, 5, "a", True), log_row(3, 3, "a", False)]
    latest = E.latest_results(spark.createDataFrame(rows, SCHEMA))
    assert latest.count() == 2
    assert [r.document for r in E.open_failures(latest).collect()] == ["b"]


def test_stream_equals_batch_whatever_the_arrival_order(spark, tmp_path):
    rows = [log_row(r, 1 + r, doc, (r + i) % 2 == 0) for r in (5, 2, 9, 1) for i, doc in enumerate("abc")]
    for n in range(0, len(rows), 3):
        E.normalise_log(spark.createDataFrame(rows[n:n + 3], SCHEMA)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = {(r.column_id, r.document, r.run_id) for r in J.stream_open_failures(stream, f"{tmp_path}/out").collect()}
    batch = E.open_failures(E.latest_results(spark.createDataFrame(rows, SCHEMA)))
    assert got == {(r.column_id, r.document, r.run_id) for r in batch.collect()}


def test_six_buckets(spark):
    early = [("a", False), ("b", False), ("c", True), ("d", True), ("e", True)]
    late = [("a", True), ("b", False), ("c", False), ("d", True), ("f", True)]
    rows = [log_row(1, 1, d, p) for d, p in early] + [log_row(2, 2, d, p) for d, p in late]
    runs = spark.createDataFrame([(1, 7, dt.datetime(2024, 1, 1)), (2, 7, dt.datetime(2024, 1, 2))], "run_id long, table_id long, started_at timestamp_ntz")
    pairs = E.two_latest_runs(runs)
    got = {r.document: r.bucket for r in E.run_compare(E.run_results_outer(spark.createDataFrame(rows, SCHEMA), pairs)).collect()}
    assert got == {"a": "fixed", "b": "still_failing", "c": "newly_failing", "d": "still_passing", "e": "only_in_earlier", "f": "only_in_later"}


def test_poll_suppression_counts_from_the_last_kept(spark, tmp_path):
    times = [0, 100, 299, 300, 500, 599, 600, 2000]
    spark.createDataFrame([("p", i, t * 1000) for i, t in enumerate(times)], "project string, event_id long, at_ms long").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("project string, event_id long, at_ms long").parquet(f"{tmp_path}/in")
    got = sorted(r.at_ms // 1000 for r in J.stream_poll_suppress(stream, f"{tmp_path}/out").collect())
    assert got == [0, 300, 600, 2000]
