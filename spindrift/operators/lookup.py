"""Symbol lookups: selectors, definitions, callers, callees, outlines, service map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.strings import kind_synonyms


def selector(name: str | None = None, service: str | None = None, file: str | None = None, kind: str | None = None, language: str | None = None) -> Column:
    """A condition on symbols. A file is exact or a suffix from a slash on, ASCII case aside, with % and _ as wildcards."""
    out = F.lit(True)
    if name is not None:
        out = out & ((F.col("name") == name) | (F.col("qualified_name") == name))
    if service is not None:
        out = out & (F.col("service") == service)
    if file is not None:
        out = out & ((F.col("file") == file) | F.col("file").ilike("%/" + file.replace("\\", "\\\\")))
    if kind is not None:
        out = out & F.col("kind").isin(kind_synonyms(kind))
    if language is not None:
        out = out & (F.col("language") == language)
    return out


def definitions(symbols: DataFrame, **select: str) -> DataFrame:
    """All symbols that a selector names, by rank, file and line."""
    return symbols.where(selector(**select)).orderBy(F.desc("rank"), "file", "start_line", "id")


def neighbours(symbols: DataFrame, edges: DataFrame, direction: str, **select: str) -> DataFrame:
    """Callers or callees of the selected symbols, once for each symbol and edge kind, with ``edge_kind``.

    The selected side is filtered before the join, so edges meet a small side,
    which the optimizer may broadcast by its size.
    """
    here, there = ("dst_symbol", "src_symbol") if direction == "callers" else ("src_symbol", "dst_symbol")
    chosen = symbols.where(selector(**select)).select(F.col("id").alias(here))
    found = edges.join(chosen, here, "left_semi").select(F.col(there).alias("id"), F.col("kind").alias("edge_kind")).distinct()
    return symbols.join(found, "id").orderBy("file", "start_line", "id", "edge_kind")


def outline(symbols: DataFrame, file: str) -> DataFrame:
    """The symbols of a file; if there are none, of all files whose path ends so."""
    tier = F.when(F.col("file") == file, 0).when(F.col("file").ilike("%" + file.replace("\\", "\\\\")), 1)
    hits = symbols.withColumn("tier", tier).where("tier is not null")
    best = hits.agg(F.min("tier").alias("best"))
    return hits.join(F.broadcast(best), F.col("tier") == F.col("best")).drop("tier", "best").orderBy("file", "start_line", "id")  # one row is broadcast


def service_map(services: DataFrame, files: DataFrame) -> DataFrame:
    """Each service's stack, number of files and first entry point, by name."""
    count = files.groupBy("service").agg(F.count("*").alias("files"))
    return (
        services.join(count, services.name == count.service, "left")
        .select("name", F.coalesce("stack", F.lit("?")).alias("stack"), F.coalesce("files", F.lit(0)).cast("long").alias("files"), F.coalesce(F.get("entrypoints", F.lit(0)), F.lit("-")).alias("entrypoint"))
        .orderBy("name")
    )


def ranked(symbols: DataFrame, edges: DataFrame, k: int = 20, include_tests: bool = False, service: str | None = None) -> DataFrame:
    """The k symbols of highest rank, with a score of 100 for the first and the number of edges that reach each.

    Test callers count there, though they have no vote. Nothing if no rank is positive.
    """
    rows = symbols if include_tests else symbols.where(~F.col("is_test"))
    rows = rows if service is None else rows.where(F.col("service") == service)
    top = rows.orderBy(F.desc("rank"), "file", "start_line", "id").limit(k)
    callers = edges.join(top.select(F.col("id").alias("dst_symbol")), "dst_symbol", "left_semi").groupBy("dst_symbol").agg(F.count("*").alias("callers"))
    most = F.max("rank").over(Window.partitionBy())  # at most k rows
    scored = top.withColumn("most", most).where("most > 0").withColumn("score", F.col("rank") / F.col("most") * 100).drop("most")
    return scored.join(callers, scored.id == callers.dst_symbol, "left").withColumn("callers", F.coalesce("callers", F.lit(0)).cast("long")).drop("dst_symbol").orderBy(F.desc("rank"), "file", "start_line", "id")


def owning_service(paths: DataFrame, prefixes: DataFrame) -> DataFrame:
    """``paths`` with the service of the longest prefix that is the path or a folder above it; "." is above all.

    Each path is asked for each of its folders, so the join is on equality and
    gives a row for each folder level, not for each prefix.
    """
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("prefix"), n.alias("depth")))
    asked = paths.select("path", F.explode(F.concat(F.array(F.struct(F.lit(".").alias("prefix"), F.lit(0).alias("depth"))), folders)).alias("f")).select("path", "f.*").distinct()
    found = asked.join(prefixes.select(F.col("path").alias("prefix"), F.col("name").alias("service")), "prefix").groupBy("path").agg(F.max_by("service", "depth").alias("service"))
    return paths.join(found, "path", "left")


def dominant(rows: DataFrame, group: str, value: str) -> DataFrame:
    """The most frequent value of each group; of equally frequent ones the last in order."""
    counts = rows.groupBy(group, value).agg(F.count("*").alias("n"))
    return counts.groupBy(group).agg(F.max_by(value, F.struct("n", value)).alias(value))


def one_path(indexed: DataFrame, there: DataFrame, file: str) -> str:
    """The path that ``file`` means: an indexed one, the only one that ends so, or one that is there; else an error."""
    exact, end = F.col("path") == file, F.col("path").ilike("%" + file.replace("\\", "\\\\"))
    found = indexed.where(exact | end).select("path", exact.alias("exact")).orderBy(F.desc("exact"), "path").limit(20).collect()
    if found and (found[0]["exact"] or len(found) == 1):
        return found[0]["path"]
    if found:
        raise ValueError(f"ambiguous file {file!r}: matches {', '.join(r['path'] for r in found)}")
    plain = file.removeprefix("./")
    if there.where(F.col("path") == plain).limit(1).count():
        return plain
    raise ValueError(f"no such file {file!r}: neither indexed nor there")
