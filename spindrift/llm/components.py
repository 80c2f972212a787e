"""Connected components by alternating large-star and small-star rounds over an edge table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))  # with repeats: small stars have none


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.union(least.select("u", F.col("m").alias("v"))).distinct()


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """``edges``, written, and a digest of them that is observed on the way."""
    sums = Observation(f"edges-{uuid.uuid4().hex}")
    out = materialize(edges.observe(sums, F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("h"), F.expr("sum(cast(v as decimal(38)))").alias("s")), "edges")
    return out, tuple(sums.get[k] for k in ("n", "h", "s"))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node with an edge; the component is its smallest node.

    ``edges`` has long columns ``u`` and ``v``. Loops, repeated and null edges
    are ignored; an empty table gives an empty result. Each round is one job that
    writes to the shared folder and observes whether anything changed, so a lost
    executor costs one round at most.
    """
    now, seen = _written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(max_rounds):
        if not seen[0]:
            break
        was = seen
        now, seen = _written(_small_star(_large_star(now)))
        if was == seen:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
