"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests, in DataFrame operations only.

A sketch has cells in three tables; each paragraph digest is added to one cell
of each, as often as it comes. A cell holds how many digests it has and the sums
of their halves and of their checks. Sketches of two versions subtract cell by
cell, so what both have cancels; a cell that holds one digest, be it several
times, gives it up, and taking it out of its other cells frees more, until all
digests that differ are known with the difference of their numbers. If cells
are left over, the versions are sketched again in eight times as many cells.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bucketed, materialize

TABLES = 3
BASE_CELLS = 24
#: Paragraphs end at a line break, or at a sentence's end before a blank.
BREAK = r"\n+|(?<=[.!?])[ \t]+"
_KEY = ("bucket", "row")


def paragraphs(text: Column) -> Column:
    """The digests of a text's paragraphs, each as often as it comes; empty ones don't count."""
    return F.transform(F.filter(F.split(text, BREAK, -1), lambda p: p != ""), lambda p: F.xxhash64(p))


def _check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(-1)).bitwiseAND(0xFFFFFFFF)


def _cell(digest: Column, table: int, cells: int) -> Column:
    """Where a digest goes in a table."""
    size = cells // TABLES
    return F.pmod(F.xxhash64(digest, F.lit(table)), F.lit(size).cast("long")) + table * size


#: What a cell sums up besides the number of its digests.
_SUMS = ("high", "low", "check")
_SOME = "n <> 0 or high <> 0 or low <> 0 or check <> 0"


def sketch(rows: DataFrame, keys: tuple, digests: str, cells: int) -> DataFrame:
    """The non-empty cells (keys, cell, n, high, low, check) of the sketch of each row's array of digests."""
    each = rows.select(*keys, F.explode(digests).alias("digest"))
    spread = each.select(*keys, F.explode(F.array(*[_cell(F.col("digest"), t, cells) for t in range(TABLES)])).alias("cell"), "digest")
    halves = (F.shiftrightunsigned("digest", 32).alias("high"), F.col("digest").bitwiseAND(0xFFFFFFFF).alias("low"), _check(F.col("digest")).alias("check"))
    return spread.select(*keys, "cell", *halves).groupBy(*keys, "cell").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in _SUMS])


def peel(diff: DataFrame, keys: tuple, cells: int, rounds: int = 9) -> DataFrame:
    """What subtracted sketches give up: rows with cell -1 hold a digest (``found``) and in ``n`` how many more the first side has, others are cells left over.

    A round takes one of the tables, where no two cells can hold the same single
    digest; what it finds is taken out of the other two.
    """
    now = diff.where(_SOME).select(*keys, "cell", F.lit(0).cast("long").alias("found"), "n", *_SUMS)
    size = cells // TABLES
    for k in range(rounds):
        own = k % TABLES
        n, zero = F.col("n"), F.lit(0).cast("long")
        here = (F.col("cell") >= own * size) & (F.col("cell") < (own + 1) * size)
        # the only digest that the sums can be of, if they are of one
        now = now.withColumn("digest", F.when(here & (n != 0), F.shiftleft(F.expr("high div n"), 32).bitwiseOR(F.expr("low div n"))))
        digest = F.col("digest")
        whole = (n * F.shiftrightunsigned(digest, 32) == F.col("high")) & (n * digest.bitwiseAND(0xFFFFFFFF) == F.col("low")) & (n * _check(digest) == F.col("check"))
        pure = F.coalesce(whole & (_cell(digest, own, cells) == F.col("cell")), F.lit(False))
        row = lambda cell, found, *rest: F.struct(cell.alias("cell"), found.alias("found"), *[v.alias(c) for v, c in zip(rest, ("n", *_SUMS))])
        out = [row(_cell(digest, t, cells), zero, -n, *[-F.col(c) for c in _SUMS]) for t in range(TABLES) if t != own]
        taken = F.array(row(F.lit(-1).cast("long"), digest, n, zero, zero, zero), *out)
        kept = F.array(row(F.col("cell"), F.col("found"), n, *[F.col(c) for c in _SUMS]))
        spread = now.select(*keys, F.explode(F.when(pure, taken).otherwise(kept)).alias("r")).select(*keys, "r.*")
        now = spread.groupBy(*keys, "cell", "found").agg(*[F.sum(c).alias(c) for c in ("n", *_SUMS)]).where(f"cell < 0 or {_SOME}")
    return now


def subtract(cells: DataFrame, keys: tuple, pairs: dict) -> DataFrame:
    """Differences of the sketches of versions: ``pairs`` maps a pair's number to (its first version, its second)."""
    sides = F.array(*[F.struct(F.lit(p).alias("pair"), F.lit(v).alias("v"), F.lit(s).alias("sign")) for p, (a, b) in pairs.items() for v, s in ((a, 1), (b, -1))])
    mine = F.filter(sides, lambda s: s["v"] == F.col("version"))
    rows = cells.withColumn("__side", F.explode(mine)).select(*keys, F.col("__side.pair").alias("pair"), "cell", *[(F.col(c) * F.col("__side.sign")).alias(c) for c in ("n", *_SUMS)])
    return rows.groupBy(*keys, "pair", "cell").agg(*[F.sum(c).alias(c) for c in ("n", *_SUMS)])


def _exploded(rows: DataFrame, versions: tuple) -> DataFrame:
    """A row for each version's array."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("version"), F.col(v).alias("digests")) for k, v in enumerate(versions)]))
    return rows.select(*_KEY, each.alias("v")).select(*_KEY, "v.version", "v.digests")


def differing(rows: DataFrame, versions: tuple, pairs: dict, cells: int) -> DataFrame:
    """One attempt: for each pair with a difference, how many digests were recovered, as often as they differ (``differ``), and cells left (``over``)."""
    keys = (*_KEY, "pair")
    cells_of = sketch(_exploded(rows, versions), (*_KEY, "version"), "digests", cells)
    left = peel(subtract(cells_of, _KEY, pairs), keys, cells)
    return left.groupBy(*keys).agg(F.count_if(F.col("cell") >= 0).alias("over"), F.sum(F.when(F.col("cell") < 0, F.abs("n")).otherwise(0)).alias("differ"))


def in_order(docs: DataFrame, bucket_rows: int = 2048, segments: int = 256) -> DataFrame:
    """``docs`` (doc_id, text) with ``bucket``, ``row``, the text's ``own`` digests, and ``next_text`` and ``next``, those of the next document by descending doc_id, after the last of the first.

    Null ids come last, equal ids by the hash of the text. Ids are cut at
    quantiles into at most ``segments`` segments, and each segment into even spans of about
    ``bucket_rows`` rows. An id that has more rows than a segment (null, say)
    is a segment of its own, cut by the hash. The first row of a bucket is also
    dealt to the bucket before it, so texts move once and no task orders all rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ends = rows.agg(F.min("doc_id").alias("lo"), F.count("*").alias("n")).first()
    lo, segments = ends["lo"] or 0, max(2, min(segments, ends["n"] // bucket_rows))
    order = F.coalesce(F.col("doc_id"), F.lit(lo - 1))
    found = rows.select(order.alias("o")).agg(F.count("*").alias("n"), F.max("o").alias("hi"), F.percentile_approx("o", [k / segments for k in range(1, segments)], 10_000).alias("cuts")).first()
    per, cuts = found["n"] / segments, found["cuts"] or []
    heavy = {c: cuts.count(c) for c in cuts if cuts.count(c) > 1}
    bounds = sorted({lo - 1, *cuts, *heavy, *(c + 1 for c in heavy)})
    ties = F.array(*[F.lit(max(1, int((heavy.get(b, 0) + 1) * per / bucket_rows)) if b in heavy else 1) for b in bounds])
    starts = F.array(*[F.lit(b).cast("long") for b in bounds])
    ends = F.array(*[F.lit(b).cast("long") for b in [*bounds[1:], max(found["hi"] or 0, bounds[-1]) + 1]])
    spans = max(1, int(per / bucket_rows))
    hashed = F.xxhash64("text")
    first, last = F.element_at(starts, F.col("__segment")), F.element_at(ends, F.col("__segment"))
    inner = F.least(F.floor((F.col("__order") - first).cast("double") / (last - first) * spans), F.lit(spans - 1))
    tie_count = F.element_at(ties, F.col("__segment"))
    tie = tie_count - 1 - F.least(F.floor((hashed.cast("double") / 2.0**64 + 0.5) * tie_count), tie_count - 1)

    def place(df):
        df = df.withColumn("__order", order).withColumn("__segment", F.size(F.filter(starts, lambda b: b <= F.col("__order"))))
        return df.withColumn("bucket", F.col("__segment").cast("long") * (1 << 40) + F.when(tie_count > 1, tie).otherwise(inner).cast("long"))

    rank = lambda o, h: F.struct(o.alias("o"), (-1 - h).alias("h"))
    heads = place(rows).groupBy("__segment", "bucket").agg(F.max(rank(F.col("__order"), hashed)).alias("__head"))
    heads = materialize(heads, "heads")
    inside = F.lag("bucket").over(Window.partitionBy("__segment").orderBy(F.desc("bucket")))
    ranges = heads.groupBy("__segment").agg(F.min("bucket").alias("__least"))  # a row for each segment
    above = F.coalesce(F.lag("__least").over(Window.orderBy(F.desc("__segment"))), F.min("__least").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    ranges = ranges.select("__segment", above.alias("__above"))
    heads = heads.withColumn("__inside", inside).join(F.broadcast(ranges), "__segment").select("bucket", "__head", F.coalesce("__inside", "__above").alias("__before"))
    joined = place(rows).join(heads, "bucket")
    is_head = rank(F.col("__order"), hashed) == F.col("__head")
    own = F.struct("bucket", F.lit(False).alias("tail"))
    copies = F.when(is_head, F.array(own, F.struct(F.col("__before").alias("bucket"), F.lit(True).alias("tail")))).otherwise(F.array(own))
    joined = joined.withColumn("own", paragraphs(F.col("text")))
    dealt = joined.select("doc_id", "text", "own", "__order", F.explode(copies).alias("c")).select("doc_id", "text", "own", "__order", "c.bucket", "c.tail")
    window = Window.partitionBy("bucket").orderBy("tail", F.desc("__order"), hashed)
    dealt = dealt.withColumn("next_text", F.lead("text").over(window)).withColumn("next", F.lead("own").over(window)).withColumn("row", F.row_number().over(window))
    return dealt.where("not tail").select("bucket", "row", "doc_id", "text", "own", "next_text", "next")


def _show(cells: Column, version: int) -> Column:
    """A version's sketch as text: of each cell its place, count and sums. Checks follow from the digests where they count."""
    mine = F.array_sort(F.filter(cells, lambda c: c["version"] == version))
    one = lambda c: F.concat_ws(".", c["cell"].cast("string"), c["n"].cast("string"), F.hex(c["high"]), F.hex(c["low"]))
    return F.array_join(F.transform(mine, one), ";")


def _likeness(a: Column, b: Column, differ: Column, same: Column) -> Column:
    """Jaccard likeness of two multisets from their sizes and that of their difference; 1 for the same text alone."""
    likeness = F.when(a + b == 0, 1.0).otherwise((a + b - differ) / (a + b + differ))
    return F.when(same, 1.0).otherwise(F.least(likeness, 1 - 1 / (a + b + 1)))


def fingerprint_versions(docs: DataFrame, cells: int = BASE_CELLS, bucket_rows: int = 2048) -> DataFrame:
    """Fingerprints of each document and of an edited version of it, with their likeness and that to the next document.

    Gives doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. The edited text has its last half replaced by the
    first half of the next document's (``in_order``). Likeness is the Jaccard
    likeness of the multisets of digests, from the digests recovered from
    subtracted sketches: a paragraph counts as often as it comes. Texts that have
    the same paragraphs in another order are as if one more differed. A fingerprint also
    has a hash of the whole text, so only equal texts have equal ones. Null
    text counts as empty; texts are read whole, whatever their length; each
    repeated row has its own result; an empty table gives no rows; columns but
    doc_id and text are not read.
    """
    whole = in_order(docs, bucket_rows)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.substr("next_text", F.lit(1), half))
    rows = whole.select(*_KEY, "doc_id", "text", "next_text", "own", "next", edited.alias("edited"), n.cast("long").alias("n_chars"))
    hashes = [F.xxhash64(c).alias(f"hash{k}") for k, c in enumerate(("text", "edited", "next_text"))]
    rows = rows.select(*_KEY, "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "own", paragraphs(F.col("edited")).alias("changed"), "next", *hashes)
    rows = bucketed(rows, "versions", "bucket")
    versions, pairs = ("own", "changed", "next"), {0: (0, 1), 1: (0, 2)}

    prints = sketch(_exploded(rows, versions[:2]), (*_KEY, "version"), "digests", cells)
    prints = prints.groupBy(*_KEY).agg(F.collect_list(F.struct("version", "cell", "n", "high", "low")).alias("cells"))
    shown = prints.select(*_KEY, *[_show(F.col("cells"), v).alias(f"shown{v}") for v in (0, 1)])

    todo, solved = rows, []
    while True:
        tried = differing(todo, versions, pairs, cells)
        tried = materialize(tried.groupBy(*_KEY).agg(*[F.coalesce(F.max(F.when(F.col("pair") == p, F.col(c))), F.lit(0)).alias(f"{c}{p}") for p in pairs for c in ("over", "differ")]), "tried")
        solved.append(tried)
        failed = tried.where(reduce(lambda a, b: a | b, [F.col(f"over{p}") > 0 for p in pairs])).groupBy("bucket").agg(F.collect_set("row").alias("__failed"))
        failed = materialize(failed, "failed")
        if failed.isEmpty():
            break
        cells *= 8
        todo = rows.join(failed, "bucket").where(F.array_contains("__failed", F.col("row"))).drop("__failed")
    union = reduce(DataFrame.union, solved)
    known = union.groupBy(*_KEY).agg(*[F.min(F.when(F.col(f"over{p}") == 0, F.col(f"differ{p}"))).alias(f"differ{p}") for p in pairs])
    slim = rows.select(*_KEY, "doc_id", "n_chars", "edited_sha256", "hash0", "hash1", "hash2", *[F.size(v).alias(f"n_{v}") for v in versions])
    out = slim.join(known, list(_KEY), "left").join(shown, list(_KEY), "left")
    own, changed, following = (F.col(f"n_{v}") for v in versions)
    differ = lambda p: F.coalesce(F.col(f"differ{p}"), F.lit(0))
    return out.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.concat_ws("|", own.cast("string"), F.hex("hash0"), F.coalesce("shown0", F.lit(""))).alias("fingerprint"),
        F.concat_ws("|", changed.cast("string"), F.hex("hash1"), F.coalesce("shown1", F.lit(""))).alias("edited_fingerprint"),
        _likeness(own, changed, differ(0), F.col("hash0") == F.col("hash1")).alias("near_edited"),
        _likeness(own, following, differ(1), F.col("hash0") == F.col("hash2")).alias("near_next"),
    )
