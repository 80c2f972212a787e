"""PageRank, bounded reverse reachability and co-change mining."""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..sources.scratch import bucketed, written


#: Up to so many edges are not worth buckets.
_FEW_EDGES = 2_000_000


def _round(ranks: DataFrame, keep=written) -> tuple[DataFrame, float, float]:
    """Ranks (id, hangs, rank, was), written, with the rank that hangs loose and how much all changed, which are observed on the way."""
    sums = Observation(f"ranks-{uuid.uuid4().hex}")
    loose = F.coalesce(F.sum(F.when(F.col("hangs"), F.col("rank"))), F.lit(0.0))
    out = keep(ranks.observe(sums, loose.alias("loose"), F.sum(F.abs(F.col("rank") - F.col("was"))).alias("moved")), "ranks")
    return out, sums.get["loose"], sums.get["moved"]


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, iterations: int = 50, tolerance: float = 1e-9) -> DataFrame:
    """(id, rank): ranks that sum to one.

    ``nodes``: id. ``edges``: src_symbol, dst_symbol; parallel edges each vote.
    The rank of nodes without outgoing edges is spread evenly. It stops after
    ``iterations`` rounds, or when ranks change by less than ``tolerance`` in
    all. Edges are summed and their weights fixed once; many edges and the ranks lie
    in the same buckets of ids, so of both nothing moves. A round moves one number
    for each distinct edge, summed before the shuffle, and is one job that writes
    the ranks and observes their sums, so that
    neither lineage nor a lost executor costs more than a round.
    """
    ids = written(nodes.select("id").distinct(), "nodes")
    n = ids.count()
    if not n:
        return ids.withColumn("rank", F.lit(0.0))
    pairs = edges.groupBy("src_symbol", "dst_symbol").agg(F.count("*").alias("n"))
    out = pairs.groupBy("src_symbol").agg(F.sum("n").alias("out"))
    weighted = written(pairs.join(out, "src_symbol").select(F.col("src_symbol").alias("id"), "dst_symbol", (F.col("n") / F.col("out")).alias("share")), "votes")
    keep = written
    if weighted.count() > _FEW_EDGES:
        keep = partial(bucketed, column="id")
        weighted = keep(weighted, "votes")
    voters = weighted.select("id").distinct().withColumn("hangs", F.lit(False))
    start = ids.join(voters, "id", "left").select("id", F.coalesce("hangs", F.lit(True)).alias("hangs"), F.lit(1.0 / n).alias("rank"), F.lit(0.0).alias("was"))
    ranks, loose, _ = _round(start, keep)
    for _ in range(iterations):
        votes = weighted.join(ranks.select("id", "rank"), "id").groupBy("dst_symbol").agg(F.sum(F.col("rank") * F.col("share")).alias("votes"))
        value = F.lit((1 - damping) / n) + damping * (F.coalesce("votes", F.lit(0.0)) + F.lit(loose / n))
        ranks, loose, moved = _round(ranks.join(votes.withColumnRenamed("dst_symbol", "id"), "id", "left").select("id", "hangs", value.alias("rank"), F.col("rank").alias("was")), keep)
        if moved < tolerance:
            break
    return ranks.select("id", "rank")


def impact(edges: DataFrame, roots: DataFrame, depth: int = 2, via: str | None = None) -> DataFrame:
    """(id, depth): what reaches the roots along edges within ``depth`` steps, at its least depth; roots are left out.

    With ``via``, a column of ``roots``, also the least of the labels that come
    with it at that depth.
    """
    label = F.col(via) if via else F.lit(None).cast("string")
    front = written(roots.groupBy("id").agg(F.min(label).alias("via")), "front")
    seen, out = front.select("id"), None
    links = edges.select("src_symbol", "dst_symbol").distinct()
    for step in range(1, depth + 1):
        reached = links.join(front.withColumnRenamed("id", "dst_symbol"), "dst_symbol").groupBy("src_symbol").agg(F.min("via").alias("via")).withColumnRenamed("src_symbol", "id")
        front = written(reached.join(seen, "id", "left_anti"), "front")
        level = front.select("id", F.lit(step).alias("depth"), "via")
        out = level if out is None else out.union(level)
        seen = seen.union(front.select("id"))
        if front.isEmpty():
            break
    if out is None:
        out = front.limit(0).select("id", F.lit(0).alias("depth"), "via")
    return out if via else out.drop("via")


def impact_summary(reached: DataFrame) -> DataFrame:
    """One row of what was reached (id, file, service, depth): symbols, files, services, max_depth."""
    return reached.agg(F.count("*").alias("symbols"), F.count_distinct("file").alias("files"), F.count_distinct("service").alias("services"), F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"))


def first(rows: DataFrame, k: int | None, *order) -> DataFrame:
    """The first k of ``rows`` with ``total``, how many there are."""
    if k is None:
        return rows.orderBy(*order)
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).limit(k).join(F.broadcast(total)).orderBy(*order)  # one row


def truncation(total: int, k: int, section: str) -> tuple[str, int, int] | None:
    """(section, omitted, limit) where a section of so many rows is cut to k."""
    return (section, total - k, k) if total > k else None


def cochange(commits: DataFrame, target, most_files: int = 30) -> DataFrame:
    """(path, together_commits, target_commits, confidence_percent): files that share commits with ``target``.

    ``commits``: commit_id, path. Commits of more than ``most_files`` files don't count.
    """
    pairs = commits.distinct()
    wanted = pairs.where(F.col("path") == target).select("commit_id")
    near = pairs.join(wanted, "commit_id", "left_semi")
    fit = near.groupBy("commit_id").agg(F.count("*").alias("n")).where(F.col("n") <= most_files)
    near = near.join(fit.select("commit_id"), "commit_id", "left_semi")
    total = near.where(F.col("path") == target).agg(F.count("*").alias("target_commits"))
    together = near.where(F.col("path") != target).groupBy("path").agg(F.count("*").alias("together_commits"))
    return together.join(F.broadcast(total)).withColumn("confidence_percent", F.col("together_commits") * 100.0 / F.col("target_commits"))  # one row


def cochange_top(commits: DataFrame, target: str, there: DataFrame, k: int = 10, most_files: int = 30) -> DataFrame:
    """(file, together_commits, target_commits, confidence_percent): the k partners of ``target`` that are still there (path), the most frequent first, then by path."""
    found = cochange(commits, target, most_files).join(there.select("path").distinct(), "path", "left_semi")
    return found.withColumnRenamed("path", "file").orderBy(F.desc("together_commits"), "file").limit(k)


#: So many pairs of a task are counted at once.
_TASK_PAIRS = 1_000_000


def cochange_pairs(commits: DataFrame, most_files: int = 30) -> DataFrame:
    """(path, partner, together_commits, target_commits, confidence_percent) of all files; a commit gives at most ``most_files`` squared pairs.

    A pair moves once, the lesser path first, to one of as many tasks as their
    number asks for, and is counted there: pairs seldom repeat within a task of
    commits, so counting them before would only fill its memory.
    """
    sets = commits.groupBy("commit_id").agg(F.array_sort(F.collect_set("path")).alias("paths")).where(F.size("paths") <= most_files)
    sums = Observation(f"pairs-{uuid.uuid4().hex}")
    n = F.size("paths").cast("long")
    sets = written(sets.select("paths").observe(sums, F.sum(n * (n - 1) / 2).alias("pairs")), "commits")
    tasks = max(int(commits.sparkSession.conf.get("spark.sql.shuffle.partitions")), int((sums.get["pairs"] or 0) // _TASK_PAIRS) + 1)
    pairs = sets.select(F.posexplode("paths").alias("at", "path"), "paths").select("path", F.explode(F.slice("paths", F.col("at") + 2, most_files)).alias("partner"))
    counts = pairs.repartition(tasks, "path", "partner").groupBy("path", "partner").agg(F.count("*").alias("n"))
    total = sets.select(F.explode("paths").alias("path")).groupBy("path").agg(F.count("*").alias("target_commits"))
    ways = F.explode(F.array(F.struct("path", "partner"), F.struct(F.col("partner").alias("path"), F.col("path").alias("partner"))))
    together = counts.select(ways.alias("pair"), "n").select("pair.path", "pair.partner", F.col("n").alias("together_commits"))
    return together.join(total, "path").withColumn("confidence_percent", F.col("together_commits") * 100.0 / F.col("target_commits"))
