"""Tiered resolution of references to symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _lowest(symbols: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Of each group the two lowest ids and how many there are, up to three; cut to three before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("id"))
    few = symbols.select("id", *keys).withColumn("place", place).where("place <= 3")
    return few.groupBy(*keys).agg(F.min("id").alias(f"a{n}"), F.min(F.when(F.col("place") == 2, F.col("id"))).alias(f"b{n}"), F.count("*").alias(f"n{n}"))


def resolve(refs: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """(src_symbol, dst_symbol, kind) for each reference that some tier resolves; equal references give equal edges.

    ``refs``: src_symbol, dst_name, qualifier, scoped, kind. ``symbols``: id,
    name, file, service, module, container. ``imports``: file, name, distinct.
    A candidate has the referred name and isn't the source. With a qualifier,
    the tiers are: container of that name in the same file, in the service, or
    anywhere if the file imports the qualifier (lowest id each); then a
    top-level symbol of a module of that name in the service, if the reference
    is scoped or the qualifier imported, or anywhere if imported (only if there
    is one). Without one: the source's own container in the file (lowest id);
    then the only one in the file, in the service, or, if the file imports the
    name, anywhere.

    Equal references are looked up once, and those with a qualifier and those
    without go through their own tiers alone. Each tier is an equality join with
    a table that has one row for each group of candidates, so a name that many
    symbols and references share costs no more than others; whether the source
    is one of the group follows from the source itself.
    """
    refs = refs.groupBy("src_symbol", "dst_name", "qualifier", "scoped", "kind").agg(F.count("*").alias("__times"))
    src = symbols.select(F.col("id").alias("src_symbol"), F.col("name").alias("s_name"), F.col("file").alias("s_file"), F.col("service").alias("s_service"), F.col("module").alias("s_module"), F.col("container").alias("s_container"))
    licence = imports.select(F.col("file").alias("s_file"), F.col("name").alias("licence"), F.lit(True).alias("imported"))
    rows = refs.join(src, "src_symbol").withColumn("licence", F.coalesce("qualifier", "dst_name"))
    rows = rows.join(licence, ["s_file", "licence"], "left").withColumn("imported", F.coalesce("imported", F.lit(False)))

    q, own = F.col("qualifier"), F.col("s_name") == F.col("dst_name")
    qualified, imported = q.isNotNull(), F.col("imported")
    inside, top = own & F.coalesce(F.col("s_container") == q, F.lit(False)), own & F.col("s_container").isNull() & F.coalesce(F.col("s_module") == q, F.lit(False))
    name, file, service, container = {"name": "dst_name"}, {"file": "s_file"}, {"service": "s_service"}, {"container": "qualifier"}
    module = {"module": "qualifier"}
    loose = symbols.where("container is null")
    tiers: list[tuple[DataFrame, dict, Column, Column, bool]] = [
        (symbols, name | container | file, qualified, inside, False),
        (symbols, name | container | service, qualified, inside, False),
        (symbols, name | container, qualified & imported, inside, False),
        (loose, name | module | service, qualified & (F.col("scoped") | imported), top, True),
        (loose, name | module, qualified & imported, top, True),
        (symbols, name | file | {"container": "s_container"}, ~qualified, own, False),
        (symbols, name | file, ~qualified, own, True),
        (symbols, name | service, ~qualified, own, True),
        (symbols, name, ~qualified & imported, own, True),
    ]
    found = None
    for part in (tiers[:5], tiers[5:]):
        asked, picks = rows.where(qualified if found is None else ~qualified), []
        for n, (among, keys, applies, has_source, alone) in enumerate(part):
            group = _lowest(among, list(keys), n).withColumnsRenamed({k: f"k{n}_{k}" for k in keys})
            same = [asked[mine].eqNullSafe(group[f"k{n}_{k}"]) if k == "container" and mine == "s_container" else asked[mine] == group[f"k{n}_{k}"] for k, mine in keys.items()]
            asked = asked.join(group, same, "left").drop(*[f"k{n}_{k}" for k in keys])
            pick = F.when(F.col(f"a{n}") == F.col("src_symbol"), F.col(f"b{n}")).otherwise(F.col(f"a{n}"))
            if alone:
                applies = applies & (F.col(f"n{n}") - F.when(has_source, 1).otherwise(0) == 1)
            picks.append(F.when(applies, pick))
        these = asked.select("src_symbol", F.coalesce(*picks).alias("dst_symbol"), "kind", "__times").where("dst_symbol is not null")
        found = these if found is None else found.union(these)
    return found.withColumn("__time", F.explode(F.sequence(F.lit(1).cast("long"), "__times"))).drop("__times", "__time")
