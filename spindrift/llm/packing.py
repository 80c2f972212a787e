"""Best-fit packing of token sequences with a fixed number of open bins."""

from __future__ import annotations

import base64
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_small_batches, materialize


class _Encoder:
    """Token ids of texts. With the ranks of the same vocabulary, texts without a special token's string go by them: the ids are equal, and come faster."""

    def __init__(self, tokenizer_path: str, ranks_path: str | None, pattern: str | None, special: tuple):
        self.tokenizer_path, self.special, self.ranked = tokenizer_path, special, None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self.ranked = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def tokenizer(self):
        """Loaded when a text first needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.tokenizer_path)

    def ids(self, text: str) -> np.ndarray:
        if self.ranked and not any(s in text for s in self.special):
            return self.ranked.encode_to_numpy(text, disallowed_special=())
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")


@lru_cache(maxsize=2)
def _encoder(tokenizer_path: str, ranks_path: str | None, pattern: str | None, special: tuple) -> _Encoder:
    return _Encoder(tokenizer_path, ranks_path, pattern, special)


def _special(tokenizer_path: str) -> tuple:
    """The strings that the tokenizer takes for one token wherever they stand."""
    from tokenizers import Tokenizer

    return tuple(t.content for t in Tokenizer.from_file(tokenizer_path).get_added_tokens_decoder().values())


def token_pieces(docs: DataFrame, tokenizer_path: str, size: int = 1024, end_id: int = 2, ranks_path: str | None = None, pattern: str | None = None, place: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids), and ``place`` where a column is named for it: each whole text's token ids and ``end_id``, as little-endian uint32.

    The ids are those of the tokenizer's file; ``ranks_path`` may name the same
    vocabulary as ranks, and ``pattern`` how it splits text. Null text counts as empty, so it gives the end id alone. Only documents of
    over ``size`` ids are cut, and only their first piece may be shorter.
    """

    special = _special(tokenizer_path)

    def run(batches):
        encoder = _encoder(tokenizer_path, ranks_path, pattern, special)
        end = np.array([end_id], "<u4")
        for b in batches:
            rows: list[list] = [[] for _ in kinds]
            held = 0
            for doc, text, *at_place in zip(b.column(0).to_pylist(), b.column(1), *(c.to_pylist() for c in b.columns[2:])):
                text = text.as_py()
                ids = np.concatenate([encoder.ids(text), end]) if text else end
                cuts = [0, *range(len(ids) % size or size, len(ids) + 1, size)]
                for k, (at, to) in enumerate(zip(cuts, cuts[1:])):
                    for column, x in zip(rows, (doc, k, at, to - at, ids[at:to].tobytes(), *at_place)):
                        column.append(x)
                held += len(ids)
                if held > 2_000_000:
                    yield batch(rows)
                    rows, held = [[] for _ in kinds], 0
            yield batch(rows)

    def batch(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds.values())], list(kinds))

    kinds = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids": pa.binary()} | ({"place": pa.int64()} if place else {})
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *([F.col(place).cast("long").alias("place")] if place else [])]
    return docs.select(*columns).mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary" + (", place long" if place else ""))


class OpenBins:
    """A fixed number of open bins, found through a bitset keyed by their free space."""

    def __init__(self, size: int, limit: int):
        self.size, self.limit, self.free, self.open, self.made = size, limit, 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(size + 1)]

    def _take(self, space: int) -> int:
        bins = self.by_free[space]
        found = bins.pop()
        if not bins:
            self.free &= ~(1 << space)
        self.open -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset): the open bin with the least space that is enough, or a new one."""
        fits = self.free >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            found = self._take(space)
        else:
            if self.open == self.limit:  # the fullest closes first
                self._take((self.free & -self.free).bit_length() - 1)
            space, found = self.size, self.made
            self.made += 1
        left = space - length
        if left:
            self.by_free[left].append(found)
            self.free |= 1 << left
            self.open += 1
        return found, self.size - space


def pack(pieces: DataFrame, tasks: int, size: int = 1024, open_bins: int = 2048, look_ahead: int = 1024, place: Column | None = None) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: best-fit into sequences of ``size``.

    Each of ``tasks`` tasks packs its own share with ``open_bins`` bins and a
    state that doesn't grow with the rows; of each ``look_ahead`` pieces the
    longest are placed first. Shares are even, whatever the ids, and packed in
    hash order of all columns; with ``place`` (a long that begins at 0 and has
    no gaps) they are runs of places, packed in its order. Sequence ids are the
    task's number and a count. ``length`` has to lie in 1..``size``.
    """
    clash = {"sequence_id", "offset"} & set(pieces.columns)
    pieces = pieces.drop(*clash)
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches):
        bins, first, held, rows = OpenBins(size, open_bins), TaskContext.get().partitionId() << 40, [], 0

        def placed(t):
            lengths = t.column("length").to_numpy()
            out = np.empty((len(lengths), 2), np.int64)
            for i in np.argsort(-lengths, kind="stable"):
                out[i] = bins.place(int(lengths[i]))
            t = t.append_column("sequence_id", pa.array(first + out[:, 0])).append_column("offset", pa.array(out[:, 1].copy()))
            return t.combine_chunks().to_batches()

        for b in batches:
            held.append(b)
            rows += len(b)
            if rows >= look_ahead:
                t = pa.Table.from_batches(held)
                for at in range(0, rows - look_ahead + 1, look_ahead):
                    yield from placed(t.slice(at, look_ahead))
                held = t.slice(rows - rows % look_ahead).to_batches()
                rows %= look_ahead
        if rows:
            yield from placed(pa.Table.from_batches(held))

    if place is None:
        hashed = F.xxhash64(*pieces.columns)
        return pieces.repartition(tasks).sortWithinPartitions(hashed, *pieces.columns).mapInArrow(run, schema)
    run_rows = pieces.select((F.max(place) + 1).alias("n")).first()["n"] or 1
    share = F.least(F.floor(place * tasks / run_rows), F.lit(tasks - 1)).cast("int")
    return pieces.repartitionById(tasks, share).sortWithinPartitions(place, "start").mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, size: int = 1024, open_bins: int = 2048, docs_per_task: int = 65_536, keep_ids: bool = False, place: str | None = None, **ranks: str) -> DataFrame:
    """Pieces of all documents with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    The number of tasks follows the row count, which Parquet's footers give.
    Pieces are written before they are packed. ``place`` names a column that
    numbers the documents from 0 without gaps: sequences are then made of
    documents near one another in its order. Empty and null texts take one
    token; very long ones are cut into pieces, none of which is lost; repeated
    rows and null ids are packed as often as they come, and an empty table
    gives no rows. Other columns, whatever their names, are not read.
    """
    with in_small_batches(docs.sparkSession):
        pieces = token_pieces(docs, tokenizer_path, size, place=place, **ranks).withColumn("ids_crc32", F.crc32("ids"))
        if not keep_ids:
            pieces = pieces.drop("ids")
        pieces = materialize(pieces, "pieces")
    tasks = max(1, -(-docs.count() // docs_per_task))
    if place is None:
        return pack(pieces, tasks, size, open_bins)
    return pack(pieces, tasks, size, open_bins, place=F.col("place")).drop("place")


def in_file_order(docs: DataFrame, name: str = "place") -> DataFrame:
    """A table read from Parquet with ``name``: the place of each row by file name and row, from 0 without gaps.

    Spark names files by the partition that wrote them, so a table written in
    some order keeps it this way, however its files are dealt to tasks. What is
    broadcast is a row for each file, of which the driver has a list anyway.
    """
    file, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    sizes = docs.groupBy(file.alias("__file")).agg((F.max(row) + 1).alias("__rows"))
    before = Window.orderBy(F.length("__file"), "__file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    starts = sizes.select(F.col("__file"), F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__start"))
    placed = docs.select("*", file.alias("__file"), row.alias("__row")).join(F.broadcast(starts), "__file")
    return placed.select(*docs.columns, (F.col("__start") + F.col("__row")).alias(name))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the concatenated token ids of each sequence, of rows packed with their ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    whole = F.aggregate(parts, F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return packed.groupBy("sequence_id").agg(whole.alias("ids"))
