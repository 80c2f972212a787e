"""Mixing sources to target weights by a Pfair schedule of blocks."""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize


def units(weights: dict, resolution: int) -> dict:
    """Whole units of each positive weight, ``resolution`` in all, one at least, by largest remainder."""
    weights = {s: Fraction(w) for s, w in weights.items() if w and w > 0}
    if len(weights) > resolution:
        raise ValueError(f"{len(weights)} sources need a resolution of as many units at least, not {resolution}")
    total = sum(weights.values())
    out = {s: max(1, math.floor(w * resolution / total)) for s, w in weights.items()}
    order = sorted(weights, key=lambda s: (out[s] - weights[s] * resolution / total, str(s)))
    while (left := resolution - sum(out.values())) > 0:
        for s in order[:left]:
            out[s] += 1
    while (over := sum(out.values()) - resolution) > 0:
        for s in [s for s in reversed(order) if out[s] > 1][:over]:
            out[s] -= 1
    return out


def release(block: int, unit: int, period: int) -> int:
    return block * period // unit


def deadline(block: int, unit: int, period: int) -> int:
    return -(-(block + 1) * period // unit)


class Line:
    """The schedule of all sources, earliest deadline first, from any slot on: which blocks were dealt before says all of what follows.

    Block i of a source with u of P units may run from slot floor(iP/u) to
    before slot ceil((i+1)P/u); such windows can always be met on one line of
    slots, and after every prefix of it a source is less than one block off its
    share.
    """

    def __init__(self, unit: list[int]):
        self.unit, self.period = unit, sum(unit)

    def likely(self, t: int) -> list[int]:
        """How many blocks each source may well have before slot ``t``: its whole ones, and of those begun the ones with the earliest deadlines. From there on every deadline can be met."""
        done = [t * u // self.period for u in self.unit]
        begun = sorted((deadline(done[k], u, self.period), k) for k, u in enumerate(self.unit) if t * u % self.period)
        for _, k in begun[: t - sum(done)]:
            done[k] += 1
        return done

    def advance(self, done: list[int], t: int, end: int, out: list | None = None) -> list[int]:
        """What is dealt before ``end`` if ``done`` is before ``t``; ``out`` gets the source of each slot."""
        done = list(done)
        coming = [(release(n, u, self.period), k) for k, (n, u) in enumerate(zip(done, self.unit))]
        heapq.heapify(coming)
        ready: list = []
        for at in range(t, end):
            while coming and coming[0][0] <= at:
                k = heapq.heappop(coming)[1]
                heapq.heappush(ready, (deadline(done[k], self.unit[k], self.period), k))
            due, k = heapq.heappop(ready)
            assert at < due
            done[k] += 1
            if out is not None:
                out.append(k)
            heapq.heappush(coming, (release(done[k], self.unit[k], self.period), k))
        return done


_STATE = "stretch long, begin array<long>, done array<long>"


def _arrays(stretch: int, begin: list[int], done: list[int]) -> pa.RecordBatch:
    longs = pa.list_(pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([stretch], pa.int64()), pa.array([begin], longs), pa.array([done], longs)], ["stretch", "begin", "done"])


def timetable(spark, unit: list[int], needed: list[int], stretch: int = 1_000_000, warm_up: int = 50_000, piece: int = 1024) -> tuple[DataFrame, int, list[int]]:
    """((source, piece, slots), length, blocks of each source) of the exact schedule by which each source k gets ``needed[k]`` blocks.

    Tasks deal stretches of slots at once. Each begins with what is likely dealt
    before it, found from a place ``warm_up`` slots earlier; where the stretch
    before ends otherwise, it is dealt again from that end, until all fit
    together. So the line is the one that a single run from slot 0 would make,
    of any length and with weights as exact as the units. A row has the slots of
    ``piece`` blocks of a source.
    """
    line = Line(unit)
    most = max(deadline(n - 1, u, line.period) for n, u in zip(needed, unit) if n)
    stretches = -(-most // stretch)
    ids = spark.range(0, stretches, 1, min(stretches, 10_000))

    def first(batches):
        for b in batches:
            for k in b.column(0).to_pylist():
                warm = max(0, k * stretch - warm_up)
                begin = line.advance(line.likely(warm), warm, k * stretch)
                yield _arrays(k, begin, line.advance(begin, k * stretch, min(most, (k + 1) * stretch)))

    def again(batches):
        for b in batches:
            for k, begin in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                yield _arrays(k, begin, line.advance(begin, k * stretch, min(most, (k + 1) * stretch)))

    def dealt(batches):
        for b in batches:
            for k, begin in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                out: list[int] = []
                line.advance(begin, k * stretch, min(most, (k + 1) * stretch), out)
                source = np.array(out, np.int64)
                order = np.argsort(source, kind="stable")
                of = source[order]
                block = np.array(begin)[of] + np.arange(len(of)) - np.searchsorted(of, of)
                yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(block), pa.array(order + k * stretch)], ["source", "block", "slot"])

    state = materialize(ids.mapInArrow(first, _STATE), "stretches")
    while stretches > 1:
        before = state.select((F.col("stretch") + 1).alias("stretch"), F.col("done").alias("wanted"))
        both = state.join(before, "stretch", "left")
        wrong = both.where("wanted <> begin").select("stretch", F.col("wanted").alias("begin"))
        wrong = materialize(wrong, "wrong")
        if wrong.isEmpty():
            break
        mended = wrong.repartition("stretch").mapInArrow(again, _STATE)
        state = materialize(state.join(wrong, "stretch", "left_anti").unionByName(mended), "stretches")
    slots = materialize(state.select("stretch", "begin").mapInArrow(dealt, "source long, block long, slot long"), "slots")
    last = spark.createDataFrame([(k, n - 1) for k, n in enumerate(needed) if n], "source long, block long")
    length = slots.join(F.broadcast(last), ["source", "block"]).agg(F.max("slot")).first()[0] + 1
    slots = slots.where(F.col("slot") < length)
    blocks = [0] * len(unit)
    for r in slots.groupBy("source").count().collect():
        blocks[r["source"]] = r["count"]
    listed = F.transform(F.array_sort(F.collect_list(F.struct("block", "slot"))), lambda x: x["slot"])
    return slots.groupBy("source", F.expr(f"block div {piece}").alias("piece")).agg(listed.alias("slots")), length, blocks


def temperature_weights(counts: dict, alpha: float = 0.7) -> dict:
    """Weights in proportion to the power ``alpha`` of each source's rows."""
    return {s: n**alpha for s, n in counts.items()}


def _key(source: Column) -> Column:
    return F.when(source.isNull(), "0").otherwise(F.concat(F.lit("1"), source.cast("string")))


def mix(
    docs: DataFrame,
    weights: dict | None = None,
    block_rows: int = 16,
    resolution: int = 1 << 60,
    source: str = "source",
    order_by: str = "doc_id",
    max_epochs: int = 1_000,
    max_slots: int = 2_000_000,
    stretch: int = 1_000_000,
    max_sources: int = 1_000_000,
    bucket_rows: int = 4096,
) -> DataFrame:
    """``docs`` in a mix of target weights: rows with ``epoch``, ``block``, ``slot``, ``release``, ``deadline``, ``position``.

    ``weights`` maps source names to target weights (default: the counts to the
    power 0.7). Each source's rows, in hash order of ``order_by``, form an
    endless stream of blocks of ``block_rows`` rows, over again (``epoch``) when
    they end; the schedule gives block i of a source its ``slot``. The mix is as
    long as it takes for every row of a weighted source to come once at least,
    so no such row is lost; if a source would have to come over ``max_epochs``
    times for that (apart from filling its first block), it is an error.
    ``position`` numbers the rows without gaps; in each prefix each source is
    less than a block off its weight, however long the mix is. Sources without a
    positive weight are not in the mix; null is a source of its own, named None.
    Repeated rows and null ids are rows like others. An empty table gives an
    empty mix. Columns of ``docs`` with one of the new names, or that begin with
    ``__``, are replaced.

    Weights are taken in ``resolution`` units. Tasks make the schedule
    (`timetable`), which goes along with the rows by broadcast up to
    ``max_slots`` blocks and 10,000 sources, and is joined beyond that. The
    driver sees a row count of each source, of which there may be
    ``max_sources``. Rows are numbered within hash buckets of about
    ``bucket_rows`` rows, so a source of any size is spread over many tasks.
    """
    new = ("epoch", "block", "slot", "release", "deadline", "position")
    docs = docs.drop(*(c for c in docs.columns if c in new or c.startswith("__")))
    spark = docs.sparkSession
    listed = docs.groupBy(source).agg(F.count("*").alias("n")).limit(max_sources + 1).collect()
    if len(listed) > max_sources:
        raise ValueError(f"over {max_sources} sources; give weights to groups of them instead")
    counts = {r[source]: r["n"] for r in listed}
    given = temperature_weights(counts) if weights is None else {s: w for s, w in weights.items() if s in counts}
    unit = units(given, resolution) if any(w and w > 0 for w in given.values()) else {}
    needed = {s: -(-counts[s] // block_rows) for s in unit}
    def repeats(blocks: dict) -> None:
        for s, n in blocks.items():
            if n > max(1, max_epochs * counts[s] // block_rows):
                raise ValueError(f"source {s!r} would come {n * block_rows // counts[s]} times; give it a smaller weight or raise max_epochs")

    period = resolution
    if not unit:
        return docs.limit(0).select(*docs.columns, *(F.lit(0).cast("long").alias(c) for c in new))
    names = sorted(unit, key=str)
    least = max(release(needed[s] - 1, unit[s], period) + 1 for s in unit)
    repeats({s: least * unit[s] // period for s in unit})
    times, length, dealt = timetable(spark, [unit[s] for s in names], [needed[s] for s in names], stretch)
    blocks = dict(zip(names, dealt))
    repeats(blocks)
    keys = {s: "0" if s is None else f"1{s}" for s in unit}
    plan = spark.createDataFrame([(keys[s], counts[s], unit[s], blocks[s] * block_rows, max(1, -(-counts[s] // bucket_rows)), k) for k, s in enumerate(names)], "__key string, __n long, __unit long, __rows long, __buckets long, __source long")
    times = times.select(F.col("source").alias("__source"), F.col("piece").alias("__piece"), F.col("slots").alias("__slots"))
    if len(unit) <= 10_000:
        plan = F.broadcast(plan)
        times = F.broadcast(materialize(times, "times")) if length <= max_slots else times

    hashed = F.xxhash64(F.lit("mix"), F.col(order_by))
    rows = docs.withColumn("__key", _key(F.col(source))).join(plan, "__key").withColumn("__bucket", F.pmod(hashed, F.col("__buckets")))
    narrow = docs.select(order_by, *({source} - {order_by})).withColumn("__key", _key(F.col(source))).join(plan, "__key")
    sizes = narrow.groupBy("__key", F.pmod(hashed, F.col("__buckets")).alias("__bucket")).agg(F.count("*").alias("__size"))
    before = F.sum("__size").over(Window.partitionBy("__key").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("__key", "__bucket", F.coalesce(before, F.lit(0)).alias("__start"))
    number = F.row_number().over(Window.partitionBy("__key", "__bucket").orderBy(hashed, order_by)) - 1
    rows = rows.withColumn("__row", number).join(starts, ["__key", "__bucket"])
    rows = rows.withColumn("__row", F.col("__row") + F.col("__start"))
    rows = rows.withColumn("epoch", F.explode(F.expr("sequence(0L, (__rows - 1 - __row) div __n)")))
    rows = rows.withColumn("__row", F.expr("__row + epoch * __n")).withColumn("block", F.expr(f"__row div {block_rows}")).withColumn("__piece", F.expr("block div 1024"))
    rows = rows.join(times, ["__source", "__piece"]).withColumn("slot", F.expr("element_at(__slots, cast(block % 1024 + 1 as int))"))
    wide = lambda c: f"cast({c} as decimal(20,0))"
    rows = rows.withColumn("release", F.expr(f"{wide('block')} * {wide(period)} div __unit"))
    rows = rows.withColumn("deadline", F.expr(f"(({wide('block')} + 1) * {wide(period)} + {wide('__unit')} - 1) div __unit"))
    return rows.withColumn("position", F.expr(f"slot * {block_rows} + __row % {block_rows}")).select(*docs.columns, *new)
