"""Incremental upkeep, usage figures and packing into a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.strings import token_estimate


def outcomes(current: DataFrame, stored: DataFrame) -> DataFrame:
    """(path, outcome) of each file now there: unchanged, touched (only its time) or index; and removed for those that are gone.

    Both have path, mtime, size, hash. Equal times that aren't 0, and sizes,
    count as unchanged without a look at the hash.
    """
    old = stored.select("path", F.col("mtime").alias("o_mtime"), F.col("size").alias("o_size"), F.col("hash").alias("o_hash"), F.lit(True).alias("o_here"))
    both = current.withColumn("here", F.lit(True)).join(old, "path", "full_outer")
    same = (F.col("mtime") == F.col("o_mtime")) & (F.col("size") == F.col("o_size")) & (F.col("mtime") != 0)
    outcome = F.when(F.col("here").isNull(), "removed").when(F.col("o_here").isNull(), "index").when(same, "unchanged").when(F.col("hash") == F.col("o_hash"), "touched").otherwise("index")
    return both.select("path", outcome.alias("outcome"))


def stale(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored paths that are no longer there."""
    return stored.select("path").join(current.select("path"), "path", "left_anti")


def usage_totals(events: DataFrame) -> DataFrame:
    """(command, runs, results, tokens_saved, last_used), and a row with a null command for all."""
    return events.rollup("command").agg(F.count("*").alias("runs"), F.coalesce(F.sum("results"), F.lit(0)).alias("results"), F.coalesce(F.sum("tokens_saved"), F.lit(0)).alias("tokens_saved"), F.max("ts").alias("last_used"))


#: A line is about so many tokens, a result line costs so many (fixed values).
TOKENS_A_LINE, TOKENS_A_RESULT = 8, 30


def tokens_saved(mean_lines, results):
    """What pointers save against reading the files, rounded half up."""
    each = F.greatest(mean_lines * TOKENS_A_LINE - TOKENS_A_RESULT, F.lit(0.0))
    return F.when(results > 0, F.round(each * results)).otherwise(0).cast("long")


def fit_budget(items: DataFrame, budget: int, *order, cost: str = "cost") -> DataFrame:
    """The longest prefix of a small ordered list (a context's few items) whose costs sum to at most ``budget``, with ``used``."""
    running = F.sum(cost).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return items.withColumn("used", running).where(F.col("used") <= budget)


def text_cost(text):
    return token_estimate(text)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n): the number of rows of each table."""
    each = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    out = each[0]
    for more in each[1:]:
        out = out.union(more)
    return out
