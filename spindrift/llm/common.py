"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import scratch


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Cut the lineage with a table written to the shared folder."""
    return scratch.written(df, name, *partition_by)


def bucketed(df: DataFrame, name: str, column: str) -> DataFrame:
    """``df`` written to the shared folder in hash buckets of ``column``: later joins and grouping by it move no rows of it."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(shuffle_partitions(spark), column).option("path", scratch.path(spark, name)).saveAsTable(table)
    out = spark.table(table)
    out.schema  # resolved now: the files stay when the name goes
    spark.sql(f"DROP TABLE {table}")
    return out


@contextmanager
def in_small_batches(spark: SparkSession, rows: int = 1000):
    """What runs inside gives Python whole texts in batches of at most so many: the default of 10,000 can be a very large batch of long ones. Then the setting is as it was."""
    was = spark.conf.get(_BATCH)
    if not 0 < int(was) <= rows:
        spark.conf.set(_BATCH, rows)
    try:
        yield
    finally:
        spark.conf.set(_BATCH, was)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def doc_bucket(doc_id, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus
