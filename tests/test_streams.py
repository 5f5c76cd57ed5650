import datetime as dt

import pytest

from specaudit.session import new_folder
from specaudit.streaming import jobs as J

SUBMISSION = "table_id long, seq long, name string, position int, native_type string, status string, role string, text string"
STORED = "table_id long, column_id long, name string, position int, native_type string, status string, role string, text string, minor long"


def arriving(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def arrive(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def test_ingest_goes_on_after_a_restart(spark):
    folder = new_folder(spark, "test")
    stored = spark.createDataFrame([(1, 7, "a", 1, "Text", "draft", None, "old", 0)], STORED)
    arrive(spark, folder, [(1, 1, "a", 1, "Text", "draft", None, "new"), (1, 2, "b", 2, "Text", "draft", None, "b")], SUBMISSION)

    def run():
        rows = J.stream_ingest(arriving(spark, folder, SUBMISSION), stored, f"{folder}/job").collect()
        return sorted((r.name, r.text, r.minor) for r in rows)

    first = run()
    assert first == [("a", "new", 1), ("b", "b", 0)]
    assert run() == first  # nothing new has arrived
    arrive(spark, folder, [(1, 3, "a", 1, "Text", "draft", None, "newer")], SUBMISSION)
    assert run() == [("a", "newer", 2), ("b", "b", 0)]


EVENT = "at timestamp, entity_type string, action string"


@pytest.mark.parametrize("order", [[0, 1, 2], [2, 0, 1]])
def test_activity_counts_late_events(spark, order):
    folder = new_folder(spark, "test")
    days = [dt.datetime(2024, 1, d, 12) for d in (1, 20, 2)]
    got = {}
    for k in order:
        arrive(spark, folder, [(days[k], "x", "create"), (days[0], "x", "create")], EVENT)
        rows = J.stream_activity(arriving(spark, folder, EVENT), f"{folder}/job").collect()
        got = {r.starts.day: r.n for r in rows}
    assert got == {1: 4, 20: 1, 2: 1}


SNAPSHOT = "project string, observed_on date, snapshot_no long, ready_count long, latest_upload date, set_print string"


@pytest.mark.parametrize("order", [[0, 1, 2], [2, 0, 1], [1, 2, 0]])
def test_moved_sets_do_not_depend_on_arrival(spark, order):
    folder = new_folder(spark, "test")
    day = dt.date(2024, 1, 1)
    rows = [("p", day, 1, 5, day, "x"), ("p", day, 2, 6, day, "y"), ("p", day, 3, 6, day, "y")]
    for k in order:
        arrive(spark, folder, [rows[k]], SNAPSHOT)
        moved = J.stream_docset_moved(arriving(spark, folder, SNAPSHOT), f"{folder}/job").collect()
    assert [tuple(r) for r in moved] == [("p", 1, 2, 1)]
