"""Tables that cut the lineage: written to the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """This application's part of ``spark.checkpoint.dir``. Where that is unset, only a local session may take a folder of its machine."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spindrift-"))
        configured = spark.sparkContext.getCheckpointDir()
    return f"{configured.rstrip('/')}/tables-{spark.sparkContext.applicationId}"


def path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, *partition_by: str, batch_rows: int | None = None, options: dict[str, str] | None = None) -> DataFrame:
    """``df`` written and read again: neither its lineage nor a lost executor costs more than this step, and what it shuffled goes from disk when it is written. With ``batch_rows`` Python gets at most so many rows at once, for rows that are large. ``options`` are the writer's."""
    spark, at = df.sparkSession, path(df.sparkSession, name)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    was, kept = spark.conf.get(_BATCH), spark.conf.get(_CLEANUP)
    if batch_rows:
        spark.conf.set(_BATCH, batch_rows)
    spark.conf.set(_CLEANUP, "true")
    try:
        writer.options(compression="zstd", **(options or {})).parquet(at)
    finally:
        spark.conf.set(_BATCH, was)
        spark.conf.set(_CLEANUP, kept)
    return spark.read.schema(df.schema).parquet(at)


_BROADCAST = "spark.sql.autoBroadcastJoinThreshold"


@contextmanager
def small_broadcasts(spark: SparkSession, most: int = 1 << 16):
    """Joins that run inside broadcast by themselves only what is at most so many bytes; ``F.broadcast`` holds as always. Then the setting is as it was.

    All that is broadcast goes through the driver. Written tables are
    compressed, so tables within Spark's default of 10 MB can be many times that
    there, once for each join.
    """
    was = spark.conf.get(_BROADCAST)
    bytes_of = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    if was.startswith("-") or bytes_of(was) <= most:
        yield
        return
    spark.conf.set(_BROADCAST, str(most))
    try:
        yield
    finally:
        spark.conf.set(_BROADCAST, was)


def bucketed(df: DataFrame, name: str, column: str) -> DataFrame:
    """``df`` written to the shared folder in hash buckets of ``column``: later joins and grouping by it move no rows of it."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartition(buckets, column)  # as buckets are, so each is one file
    dealt.write.format("parquet").bucketBy(buckets, column).option("compression", "zstd").option("path", path(spark, name)).saveAsTable(table)
    out = spark.table(table)
    out.schema  # resolved now: the files stay when the name goes
    spark.sql(f"DROP TABLE {table}")
    return out


def place(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for ``path``, wherever it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def clear(spark: SparkSession) -> bool:
    """Delete what this application wrote; for the end of a job, when no result of it is read any more."""
    files, at = place(spark, folder(spark))
    return files.delete(at, True)
