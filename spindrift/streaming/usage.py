"""Usage events as a stream: an extension beyond the batch totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.upkeep import usage_totals


def windowed_usage(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Runs and results of each command and window of time; later events than ``late`` don't count."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "command").agg(F.count("*").alias("runs"), F.sum("results").alias("results")).select(F.col("w.start").alias("start"), "command", "runs", "results")


def keep_totals(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append each batch's totals to ``path``, once for each batch number however often it is tried.

    A batch's folder is overwritten when the batch is run again.
    """

    def put(batch: DataFrame, number: int) -> None:
        usage_totals(batch).where("command is not null").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return events.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_totals(spark, path: str) -> DataFrame:
    """The totals over all batches."""
    parts = spark.read.parquet(path)
    return parts.groupBy("command").agg(F.sum("runs").alias("runs"), F.sum("results").alias("results"), F.sum("tokens_saved").alias("tokens_saved"), F.max("last_used").alias("last_used"))
