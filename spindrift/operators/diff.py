"""Semantic differences of two snapshots of symbols, their risk, and what they affect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import impact

#: Points for the kind of a change (fixed values).
BASE_RISK = {"docs": 0, "added": 1, "body": 1, "file": 1, "renamed": 1, "signature": 3, "deleted": 4}


def compare(old: DataFrame, new: DataFrame) -> DataFrame:
    """(file, name, kind, occurrence, nature, signature, container, public, at_base) of what changed, with line and is_test where both have them.

    Snapshots have file, name, kind, ordinal, signature, body_hash, doc,
    container, public. ``file`` names a pair of files, whatever their paths. The n-th symbol of a file, name and kind is compared with
    the n-th of the other side; containers play no part. ``nature``: added,
    deleted, or the first of signature, body, docs that differs.
    """
    keys = ["file", "name", "kind", "occurrence"]
    nth = F.row_number().over(Window.partitionBy("file", "name", "kind").orderBy("ordinal"))
    more = [c for c in ("line", "is_test") if c in old.columns and c in new.columns]
    fields = ["signature", "body_hash", "doc", "container", "public", *more]
    side = lambda df, p: df.withColumn("occurrence", nth).select(*keys, F.lit(True).alias(f"{p}here"), *[F.col(c).alias(f"{p}{c}") for c in fields])
    both = side(old, "o_").join(side(new, "n_"), keys, "full_outer")
    nature = (
        F.when(F.col("o_here").isNull(), "added")
        .when(F.col("n_here").isNull(), "deleted")
        .when(~F.col("o_signature").eqNullSafe(F.col("n_signature")), "signature")
        .when(~F.col("o_body_hash").eqNullSafe(F.col("n_body_hash")), "body")
        .when(~F.col("o_doc").eqNullSafe(F.col("n_doc")), "docs")
    )
    pick = lambda c: F.when(F.col("n_here").isNotNull(), F.col(f"n_{c}")).otherwise(F.col(f"o_{c}")).alias(c)
    return both.select(*keys, nature.alias("nature"), pick("signature"), pick("container"), pick("public"), *map(pick, more), F.col("n_here").isNull().alias("at_base")).where("nature is not null")


def score(changes: DataFrame) -> DataFrame:
    """``changes`` (nature, public, direct_references, cross_service) with ``risk_score`` and ``risk``."""
    base = F.create_map(*[F.lit(x) for pair in BASE_RISK.items() for x in pair])[F.col("nature")]
    refs = F.when(F.col("direct_references") == 0, 0).when(F.col("direct_references") <= 3, 1).otherwise(2)
    points = base + F.when(F.col("public") & (F.col("nature") != "docs"), 2).otherwise(0) + refs + F.when(F.col("cross_service"), 2).otherwise(0)
    return changes.withColumn("risk_score", points.cast("int")).withColumn("risk", risk_label(F.col("risk_score")))


def risk_label(points: Column) -> Column:
    return F.when(points <= 2, "low").when(points <= 5, "medium").otherwise("high")


def direct_references(edges: DataFrame, live: DataFrame, lost: DataFrame) -> DataFrame:
    """(name, direct_references): of each name the most distinct sources of any live symbol (id, name) or of the deleted ones (name, src_symbol)."""
    direct = edges.join(live.select(F.col("id").alias("dst_symbol"), "name"), "dst_symbol").select("name", F.col("dst_symbol").alias("of"), "src_symbol").distinct()
    each = direct.groupBy("name", "of").agg(F.count("*").alias("n")).select("name", "n").union(lost.groupBy("name").agg(F.count("*").alias("n")))
    return each.groupBy("name").agg(F.max("n").alias("direct_references"))


def crossing(changes: DataFrame, affected: DataFrame) -> DataFrame:
    """(name, cross_service = true) of changes (name, service) through whose name something of another service is affected (via, service)."""
    own = changes.where("name is not null").select("name", F.col("service").alias("own")).distinct()
    reached = affected.select(F.col("via").alias("name"), "service").distinct()
    return reached.join(own, "name").where("service <> own").select("name", F.lit(True).alias("cross_service")).distinct()


def affected(edges: DataFrame, changed: DataFrame, symbols: DataFrame, depth: int = 3) -> DataFrame:
    """(id, depth, via, is_test): what reaches changed symbols (id, name), and changed tests at depth 0.

    Direct callers come at depth 1 whatever ``depth`` is; ``via`` is the least
    name of a changed symbol on a shortest way. All changed symbols are left out
    of the callers.
    """
    reached = impact(edges, changed, max(1, depth), via="name")
    tests = symbols.select("id", "is_test")
    own = changed.join(tests.where("is_test"), "id").groupBy("id").agg(F.min("name").alias("via")).select("id", F.lit(0).alias("depth"), "via", F.lit(True).alias("is_test"))
    return reached.join(tests, "id").select("id", "depth", "via", "is_test").union(own)


def callers_of_deleted(deleted: DataFrame, refs: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """(name, src_symbol) of references to symbols that are no longer there.

    ``deleted``: name, service, container, module. A reference counts if its
    source is in the service or its file imports the name or the qualifier, and
    its qualifier is the container (or, at top level, the module), or, without
    one, the source's container is the same where there is one.

    Each way to agree is an equality with a table of distinct keys, so a name that
    very many references and deleted symbols share is no product of both.
    """
    src = symbols.select(F.col("id").alias("src_symbol"), F.col("file").alias("s_file"), F.col("service").alias("s_service"), F.col("container").alias("s_container"))
    lost = deleted.select("name", "service", "container", "module").distinct()
    rows = refs.select("src_symbol", F.col("dst_name").alias("name"), "qualifier").distinct().join(lost.select("name").distinct(), "name", "left_semi").join(src, "src_symbol")
    held = imports.select(F.col("file").alias("s_file"), F.col("name").alias("i_name")).distinct().withColumn("held", F.lit(True))
    asked = rows.withColumn("i_name", F.explode(F.array_distinct(F.array("name", F.coalesce("qualifier", "name"))))).join(held, ["s_file", "i_name"], "left")
    q, c, empty = F.col("qualifier"), F.col("container"), F.lit("")
    pair = lambda by, value: F.struct(F.lit(by).alias("by"), value.alias("value"))
    each = lambda *pairs: F.explode(F.filter(F.array(*pairs), lambda w: w["value"].isNotNull()))
    keys = lost.withColumn("way", each(pair("container", c), pair("top", F.when(c.isNull(), empty)), pair("module", F.when(c.isNull(), F.col("module")))))
    keys = keys.select("name", "way", each(pair("service", F.col("service")), pair("any", empty)).alias("where")).distinct()
    rows = asked.withColumn("way", each(pair("container", F.coalesce(q, F.col("s_container"))), pair("top", F.when(q.isNull(), empty)), pair("module", q)))
    rows = rows.select("name", "src_symbol", "way", each(pair("service", F.col("s_service")), pair("any", F.when(F.col("held"), empty))).alias("where"))
    return rows.join(keys, ["name", "way", "where"], "left_semi").select("name", "src_symbol").distinct()


def file_status(code: str, old: str | None, new: str | None) -> tuple[str, str | None, str | None]:
    """A status letter of a name-status listing and its paths, as (status, old path, new path)."""
    kind = {"A": "added", "D": "deleted", "M": "modified", "T": "modified", "R": "renamed", "C": "renamed"}.get(code[:1])
    if kind is None:
        raise ValueError(f"unknown status {code!r}")
    return kind, (None if kind == "added" else old), (None if kind == "deleted" else new or old)
