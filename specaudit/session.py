"""Session set-up, the shared folder and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benches, with a folder of its own where none is set; a cluster brings its own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("specaudit")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
    )
    spark = builder.getOrCreate()
    if spark.conf.get("spark.checkpoint.dir", None):
        return spark
    spark.stop()  # the setting is fixed once a session has started
    return builder.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp")).getOrCreate()


BROADCAST_BYTES = 1 << 20


def bound_broadcasts(spark: SparkSession) -> None:
    """Let only tables of up to 1 MB be sent to every task by way of the driver.

    A table is judged by its size in files, where keys in order and names that repeat take a tenth or less of what they take
    as a hash table in the driver, and one query may hold dozens of such tables there at once. A session that allows less, or
    none (-1), is left as it is.
    """
    key = "spark.sql.autoBroadcastJoinThreshold"
    now = spark.conf.get(key)
    if not now.startswith("-") and spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now) > BROADCAST_BYTES:
        spark.conf.set(key, str(BROADCAST_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables, which the driver and every executor can reach."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir, when the session is built, to a folder that every executor can reach")
    return folder.rstrip("/")


def new_folder(spark: SparkSession, kind: str = "table") -> str:
    """A fresh place in the shared folder, under the application's id."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to a table in the shared folder and read them back.

    The written files survive the loss of any executor, end the lineage of an iterative job,
    and give the next plan a real size to choose its join strategy from.
    """
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def is_written(spark: SparkSession, path: str) -> bool:
    """Whether a table has been written there completely."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)


def discard(*tables: DataFrame) -> None:
    """Delete the files of written rounds that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        for file in table.inputFiles():
            folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
            break
