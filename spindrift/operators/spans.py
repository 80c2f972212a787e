"""Lexical containment: parents, qualified names, owners of references, test flags.

Spans have ``file``, ``id`` (unique in the file, in extraction order),
``start_line`` and ``end_line``. Joins are on file and band of lines, so a file
of any length falls into many small groups; a band is as wide as ``band``. Where
spans have ``start_col`` and ``end_col`` too, what holds what, and whose a
reference is, goes by line and column, so several definitions on a line nest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _at(df: DataFrame, line: str, column: str):
    """A place as one number: lines first, then columns, if there are any."""
    return F.col(line) * (1 << 24) + (F.col(column) if column in df.columns else 0)


def _holders(spans: DataFrame, points: DataFrame, band: int) -> DataFrame:
    """Rows of ``points`` (file, p_start, p_end, …) with each span whose lines contain theirs."""
    kind = [c for c in ("kind",) if c in spans.columns]
    places = (_at(spans, "start_line", "start_col").alias("o_from"), _at(spans, "end_line", "end_col").alias("o_to"))
    outer = spans.select("file", F.col("id").alias("o_id"), F.col("start_line").alias("o_start"), F.col("end_line").alias("o_end"), *places, *kind)
    outer = outer.withColumn("__band", F.explode(F.sequence(F.floor(F.col("o_start") / band), F.floor(F.col("o_end") / band))))
    inner = points.withColumn("__band", F.floor(F.col("p_start") / band))
    return inner.join(outer, ["file", "__band"]).where("o_start <= p_start and o_end >= p_end").drop("__band")


def enclosing(spans: DataFrame, strict: bool = False, band: int = 64) -> DataFrame:
    """(file, id, enclosing): the smallest other span around each, ties to the lowest id; null if none.

    With ``strict`` a span of equal lines is not around.
    """
    points = spans.select("file", "id", F.col("start_line").alias("p_start"), F.col("end_line").alias("p_end"))
    around = _holders(spans, points, band).where("o_id <> id")
    if strict:
        around = around.where("o_start < p_start or o_end > p_end")
    best = around.groupBy("file", "id").agg(F.min_by("o_id", F.struct(F.expr("o_end - o_start"), "o_id")).alias("enclosing"))
    return spans.select("file", "id").join(best, ["file", "id"], "left")


def _points(spans: DataFrame) -> DataFrame:
    return spans.select("file", "id", F.col("start_line").alias("p_start"), F.col("end_line").alias("p_end"), _at(spans, "start_line", "start_col").alias("p_from"), _at(spans, "end_line", "end_col").alias("p_to"))


_STRICTLY = "o_from <= p_from and o_to >= p_to and (o_from < p_from or o_to > p_to)"


def lexical_identity(spans: DataFrame, band: int = 64) -> DataFrame:
    """``spans`` (with name) with ``container``, the parent's name, and ``qualified_name``, all ancestors joined by ``::``.

    Ancestors are the spans strictly around, from the widest in; for nested
    spans this is the chain of parents.
    """
    around = _holders(spans, _points(spans), band).where(_STRICTLY)
    names = spans.select("file", F.col("id").alias("o_id"), F.col("name").alias("o_name"))
    chain = around.join(names, ["file", "o_id"]).groupBy("file", "id").agg(F.array_sort(F.collect_list(F.struct(F.expr("o_from - o_to").alias("size"), F.expr("-o_id").alias("o"), "o_name"))).alias("chain"))
    out = spans.join(chain, ["file", "id"], "left")
    above = F.transform("chain", lambda c: c["o_name"])
    return out.withColumn("container", F.element_at(above, -1)).withColumn("qualified_name", F.array_join(F.concat(F.coalesce(above, F.array().cast("array<string>")), F.array("name")), "::")).drop("chain")


CALLABLE = ("fn", "def", "method", "function")


def edge_owners(spans: DataFrame, refs: DataFrame, band: int = 64) -> DataFrame:
    """``refs`` (file, line, kind, ref_id) with ``owner``: for calls the innermost callable around the line, else the innermost span.

    With columns (``col`` of references) those around the place come first.
    References outside every span are dropped.
    """
    points = refs.select("file", "ref_id", F.col("kind").alias("ref_kind"), F.col("line").alias("p_start"), F.col("line").alias("p_end"), _at(refs, "line", "col").alias("p_at"))
    around = _holders(spans, points, band)
    other = F.when((F.col("ref_kind") == "call") & F.col("kind").isin(*CALLABLE), 0).otherwise(1)
    elsewhere = (F.col("p_at") < F.col("o_from")) | (F.col("p_at") >= F.col("o_to")) if "col" in refs.columns and "start_col" in spans.columns else F.lit(False)
    best = around.groupBy("file", "ref_id").agg(F.min_by("o_id", F.struct(elsewhere, other, F.expr("o_to - o_from"), "o_id")).alias("owner"))
    return refs.join(best, ["file", "ref_id"])


def inherited_flags(spans: DataFrame, flag: str = "is_test", band: int = 64) -> DataFrame:
    """``spans`` with ``flag`` also set where a span strictly around has it."""
    around = _holders(spans.where(F.col(flag)), _points(spans.where(~F.col(flag))), band).where(_STRICTLY)
    flagged = around.select("file", "id", F.lit(True).alias("__inherited")).distinct()
    return spans.join(flagged, ["file", "id"], "left").withColumn(flag, F.col(flag) | F.col("__inherited").isNotNull()).drop("__inherited")


def own_lines(lines: DataFrame, spans: DataFrame, band: int = 64) -> DataFrame:
    """(file, id, line, text): each span's lines without those of spans that start later or end earlier inside it."""
    points = lines.select("file", F.col("line").alias("p_start"), F.col("line").alias("p_end"), "text")
    inside = _holders(spans, points, band).select("file", F.col("p_start").alias("line"), "text", F.col("o_id").alias("id"), "o_start", "o_end")
    # a line is hidden in a span if another span that holds the line lies within it: compare each with the line's latest start and earliest end
    edge = inside.groupBy("file", "line").agg(F.max("o_start").alias("latest"), F.min("o_end").alias("earliest"))
    return inside.join(edge, ["file", "line"]).where("o_start = latest and o_end = earliest").select("file", "id", "line", "text")


def text_hash(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, hash): Git's blob hash of each group's lines, in order, joined by line ends."""
    from ..functions.strings import blob_hash

    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")
    return rows.groupBy(*keys).agg(body.alias("__body")).select(*keys, blob_hash(F.col("__body")).alias("hash"))


def outside_lines(lines: DataFrame, spans: DataFrame, band: int = 64) -> DataFrame:
    """The lines that no span covers."""
    points = lines.select("file", F.col("line").alias("p_start"), F.col("line").alias("p_end"))
    covered = _holders(spans, points, band).select("file", F.col("p_start").alias("line")).distinct()
    return lines.join(covered, ["file", "line"], "left_anti")
