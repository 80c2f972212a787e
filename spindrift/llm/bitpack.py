"""Token ids as bits: each id takes the fewest bits that hold the vocabulary.

A written set is a folder of Parquet: ``shards`` (shard, start, n_tokens) and
``blocks``, a row for each run of whole documents of about ``block_tokens`` ids:

    shard, block     which run, in order
    first, n_tokens  ids of the shard before it, ids in it
    least, most      the smallest and largest doc_id
    doc_ids, lengths the documents in order, and their numbers of ids
    bits, data       the width, and the ids: id i has bits [i * bits, (i + 1) * bits), lowest first

Id i of a block begins at bit i * bits, so any span is unpacked by itself; which
block has it, ``first`` tells, and which file, Parquet's figures on ``shard``,
``first``, ``least`` and ``most``. A shard is a range of doc_ids in order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import in_small_batches, materialize
from .packing import _encoder, _special

_STRIP = 1 << 16  # ids at a time; a multiple of 8, so each strip ends on a byte


def width_of(vocabulary: int) -> int:
    """The fewest bits that hold ids 0..vocabulary-1."""
    return max(1, (vocabulary - 1).bit_length())


def pack_ids(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` at ``bits`` each, lowest bit first; the last byte is filled with zeros."""
    ids = np.ascontiguousarray(ids, "<u4")
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"id {int(ids.max())} takes more than {bits} bits")
    if bits % 8 == 0:
        return ids.view(np.uint8).reshape(-1, 4)[:, : bits // 8].tobytes()
    strips = (ids[at : at + _STRIP].view(np.uint8).reshape(-1, 4) for at in range(0, len(ids), _STRIP))
    return b"".join(np.packbits(np.unpackbits(s, axis=1, count=bits, bitorder="little"), bitorder="little").tobytes() for s in strips)


def unpack_ids(data, bits: int, first: int, n: int) -> np.ndarray:
    """Ids ``first``..``first`` + ``n`` - 1 of packed ``data``, as little-endian uint32; nothing else of it is touched."""
    raw = np.frombuffer(data, np.uint8)
    if bits % 8 == 0:
        out, step = np.zeros((n, 4), np.uint8), bits // 8
        out[:, :step] = raw[first * step : (first + n) * step].reshape(n, step)
        return out.view("<u4").ravel()
    parts = [np.zeros(0, "<u4")]
    for at in range(first, first + n, _STRIP):
        m = min(_STRIP, first + n - at)
        begin = at * bits
        strip = np.unpackbits(raw[begin // 8 : -(-(begin + m * bits) // 8)], bitorder="little")[begin % 8 :][: m * bits]
        wide = np.zeros((m, 32), np.uint8)
        wide[:, :bits] = strip.reshape(m, bits)
        parts.append(np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel())
    return np.concatenate(parts)


_BLOCKS = [("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_tokens", pa.int64()), ("least", pa.int64()), ("most", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("bits", pa.int32()), ("data", pa.binary())]


def _to_blocks(bits: int, block_tokens: int, end_id: int, *encoding):
    """Rows (doc_id, text) in order to blocks of whole documents."""

    def run(batches):
        encoder, end = _encoder(*encoding), np.array([end_id], "<u4")
        shard, number, before = TaskContext.get().partitionId(), 0, 0
        ids: list = []
        parts: list[np.ndarray] = []
        held = 0

        def block():
            nonlocal number, before, held
            known = [i for i in ids if i is not None]
            row = [shard, number, before, held, min(known, default=None), max(known, default=None), list(ids), [len(p) for p in parts], bits, pack_ids(np.concatenate(parts), bits)]
            number, before, held = number + 1, before + held, 0
            ids.clear()
            parts.clear()
            return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, (_, kind) in zip(row, _BLOCKS)], [name for name, _ in _BLOCKS])

        for b in batches:
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                text = text.as_py()
                ids.append(i)
                parts.append(np.concatenate([encoder.ids(text), end]) if text else end)
                held += len(parts[-1])
                if held >= block_tokens:
                    yield block()
        if ids:
            yield block()

    return run


def write_ids(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, block_tokens: int = 1 << 16, shard_bytes: int = 64 << 20, ranks_path: str | None = None, pattern: str | None = None) -> None:
    """Write the ids of all whole texts, each with ``end_id`` after it, in ascending doc_id order to the folder ``path``.

    Null and empty texts have the end alone. Rows without an id come first;
    equal ids lie side by side, ordered by what they hold; repeated rows are
    written as often as they come; one id with very many rows goes over several
    shards. A document of any length is in one block, which grows with it. An
    empty table gives a set without blocks. Other columns, whatever their
    names, are not read. A shard holds about ``shard_bytes`` of text, which moves
    once, before it is encoded.
    """
    from tokenizers import Tokenizer

    bits = width_of(max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end_id + 1))
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # equal rows are told apart by their place in the input
    order = [F.col("doc_id").asc_nulls_first(), F.col("hash"), F.col("number")]
    rows = rows.withColumn("hash", F.xxhash64("text")).withColumn("number", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(max(1, -(-total // shard_bytes)), *order).sortWithinPartitions(*order).select("doc_id", "text")
    kinds = "shard int, block int, first long, n_tokens long, least long, most long, doc_ids array<long>, lengths array<long>, bits int, data binary"
    with in_small_batches(spark):
        blocks = rows.mapInArrow(_to_blocks(bits, block_tokens, end_id, tokenizer_path, ranks_path, pattern, _special(tokenizer_path)), kinds)
        blocks.write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    sizes = _blocks(spark, path).groupBy("shard").agg(F.sum("n_tokens").alias("n_tokens"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    sizes.select("shard", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start"), "n_tokens").write.parquet(f"{path}/shards")


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/blocks")


def _shards(spark: SparkSession, path: str) -> DataFrame:
    """A row for each file of ``shard_bytes``: small enough to go to all tasks."""
    return F.broadcast(spark.read.parquet(f"{path}/shards").select("shard", "start"))


def _documents(wanted):
    """Blocks to (doc_id, start, n_tokens, ids) of the documents for which ``wanted`` holds."""

    def run(batches):
        for b in batches:
            for at in range(len(b)):
                row = {name: b.column(name)[at] for name in b.schema.names}
                data, bits = row["data"].as_buffer(), row["bits"].as_py()
                ids, lengths = row["doc_ids"].as_py(), np.array(row["lengths"].as_py(), np.int64)
                first = np.cumsum(lengths) - lengths
                start = first + row["first"].as_py() + row["start"].as_py()
                mine = [j for j, i in enumerate(ids) if wanted is None or i in wanted]
                if len(mine) == len(ids):
                    whole = unpack_ids(data, bits, 0, int(lengths.sum()))
                    parts = [whole[f : f + n].tobytes() for f, n in zip(first, lengths)]
                else:
                    parts = [unpack_ids(data, bits, int(first[j]), int(lengths[j])).tobytes() for j in mine]
                yield pa.RecordBatch.from_arrays([pa.array([ids[j] for j in mine], pa.int64()), pa.array(start[mine], pa.int64()), pa.array(lengths[mine], pa.int64()), pa.array(parts, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return run


_READ = "doc_id long, start long, n_tokens long, ids binary"


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): every document of a written set; ids as little-endian uint32, ``start`` the ids of all documents before it.

    Rows are blocks of about 128 KB, so run what reads it in small batches.
    """
    return _blocks(spark, path).join(_shards(spark, path), "shard").mapInArrow(_documents(None), _READ)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): what each document's ids in the files come to."""
    with in_small_batches(spark, 32):
        return materialize(read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")), "digests")


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """As `read_ids`, of some documents: only the files and blocks whose range has one of them are read, and only their bits unpacked."""
    wanted = frozenset(doc_ids)
    near = F.lit(False)
    for i in sorted(wanted):
        near = near | ((F.col("least") <= i) & (F.col("most") >= i))
    return _blocks(spark, path).where(near).join(_shards(spark, path), "shard").mapInArrow(_documents(wanted), _READ)


def read_span(spark: SparkSession, path: str, start: int, n: int) -> np.ndarray:
    """Ids ``start``..``start`` + ``n`` - 1 of the whole set (fewer at its end), whatever documents they belong to."""
    end = start + n
    shards = spark.read.parquet(f"{path}/shards").where((F.col("start") < end) & (F.col("start") + F.col("n_tokens") > start)).collect()
    near, begins = F.lit(False), {r["shard"]: r["start"] for r in shards}
    for shard, begin in begins.items():
        near = near | ((F.col("shard") == shard) & (F.col("first") < end - begin) & (F.col("first") + F.col("n_tokens") > start - begin))
    parts = [np.zeros(0, "<u4")]
    for r in sorted(_blocks(spark, path).where(near).select("shard", "first", "n_tokens", "bits", "data").collect(), key=lambda r: (r["shard"], r["first"])):
        begin = begins[r["shard"]] + r["first"]
        a, b = max(start, begin), min(end, begin + r["n_tokens"])
        parts.append(unpack_ids(r["data"], r["bits"], a - begin, b - a))
    return np.concatenate(parts)
