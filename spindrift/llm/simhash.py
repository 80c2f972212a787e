"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming check, components.

Two uses. ``near_duplicates`` links fingerprints of 64 bits within a few bits;
every such pair agrees on some choice of blocks, so none is missed.
``similar_texts`` links texts by the similarity of their sets of shingles. At a
Jaccard similarity of 0.8 over 15 % of the bits differ, where no number of
blocks is both sure and selective; so its fingerprints are longer, split into as
many blocks as find a pair at the limit with a wanted probability, and pairs
that pass the Hamming check are verified by their shingles.
"""

from __future__ import annotations

import logging
import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches, materialize
from .components import connected_components

log = logging.getLogger(__name__)
BITS = 64
_PIECE = 1 << 20


def word_pieces(text: bytes):
    """Word lists of a text in pieces of about a megabyte, cut at white space."""
    at, n = 0, len(text)
    while at < n:
        end = min(n, at + _PIECE)
        while end < n and text[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        yield text[at:end].split()
        at = end


def shingle_hashes(text: bytes, width: int = 3, seed: int = 42):
    """Arrays of the XXH64 of each word shingle; fewer words than ``width`` make one shingle, none make none."""
    digest, carry, wide = xxhash.xxh64_intdigest, [], False
    for words in word_pieces(text.lower()):
        words = carry + words
        n = len(words) - width + 1
        if n > 0:
            wide = True
            shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
            yield np.fromiter((digest(s, seed) for s in shingles), np.uint64, n)
        carry = words[-(width - 1):] if width > 1 else []
    if not wide and carry:
        yield np.array([digest(b" ".join(carry), seed)], np.uint64)


_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint_of(text: bytes, width: int = 3) -> int:
    """A bit is 1 if set in over half the shingle hashes; without words it is zero."""
    total, ones = 0, np.zeros(BITS, np.int64)
    for hashes in shingle_hashes(text, width):
        total += len(hashes)
        lanes = hashes.view(np.uint8).reshape(-1, 8)
        for lane in range(8):
            ones[lane * 8 : lane * 8 + 8] += np.bincount(lanes[:, lane], minlength=256) @ _BYTE_BITS
    return int(np.packbits(ones * 2 > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): the SimHash of each whole text as a signed long. Null text counts as empty."""

    def run(batches):
        for b in batches:
            texts = (t.as_py() for t in b.column(1))
            fps = np.array([fingerprint_of(t.encode(), width) if t else 0 for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _blocks(max_distance: int, extra: int) -> list[int]:
    """Masks of bits: two fingerprints within the distance agree on all bits of one mask at least.

    ``max_distance + extra`` runs of bits; at most ``max_distance`` of them can
    differ, so some choice of ``extra`` runs is equal in both.
    """
    n = max_distance + extra
    edges = [BITS * i // n for i in range(n + 1)]
    runs = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(runs, extra)]


def runs_beside(rows: int) -> int:
    """How many runs have to agree: 2 (masks of 25 bits) up to a billion fingerprints, then 3 (32 bits) and 4 (36 bits), so that unrelated ones share few buckets."""
    return 2 + (rows > 1 << 30) + (rows > 1 << 36)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _bucket_links(fps: np.ndarray, reps: np.ndarray, max_distance: int):
    """(node, smallest node it reaches) inside one bucket; rows of the distance matrix are made a strip at a time."""
    n, label = len(fps), reps.copy()
    strip = max(1, (1 << 22) // n)
    while True:
        new = label.copy()
        for at in range(0, n, strip):
            near = np.bitwise_count(fps[at : at + strip, None] ^ fps[None, :]) <= max_distance
            np.minimum(new[at : at + strip], np.where(near, label[None, :], np.iinfo(np.int64).max).min(1), out=new[at : at + strip])
        if (new == label).all():
            break
        label = new
    moved = label != reps
    return reps[moved], label[moved]


def _by_bucket(pairs, bucket):
    """Rows sorted by (mask, value, part) to the links (u, v) of each bucket: ``pairs(fps, reps, at)`` of the buckets of two rows, at their first rows, ``bucket(fps, reps)`` of each larger one."""

    def run(batches):
        """A bucket may go over several batches."""
        held = None

        def links(t):
            keys = (t.column("mask").to_numpy(), t.column("value").to_numpy(), t.column("part").to_numpy())
            fps, reps = _prints(t.column("fp")), t.column("rep").to_numpy()
            cut = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            starts, ends = np.r_[0, cut], np.r_[cut, len(reps)]
            size = ends - starts
            at = starts[size == 2]
            at = at[pairs(fps[at], fps[at + 1])]
            out_u, out_v = [np.maximum(reps[at], reps[at + 1])], [np.minimum(reps[at], reps[at + 1])]
            for a, b in zip(starts[size > 2], ends[size > 2]):
                u, v = bucket(fps[a:b], reps[a:b])
                out_u.append(u)
                out_v.append(v)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_u)), pa.array(np.concatenate(out_v))], ["u", "v"])

        for b in batches:
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            t = t.combine_chunks()
            if not len(t):
                continue
            last = [t.column(c).to_numpy() for c in ("mask", "value", "part")]
            open_at = int(np.flatnonzero(np.any([k != k[-1] for k in last], axis=0))[-1]) + 1 if any((k != k[-1]).any() for k in last) else 0
            if open_at:
                yield links(t.slice(0, open_at))
            held = t.slice(open_at)
        if held is not None and len(held):
            yield links(held.combine_chunks())

    return run


def _prints(column: pa.ChunkedArray) -> np.ndarray:
    """Fingerprints: of a column of longs one word each, of binaries a row of words each."""
    if pa.types.is_integer(column.type):
        return column.to_numpy().view(np.uint64)
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def _links(max_distance: int):
    return _by_bucket(lambda a, b: np.bitwise_count(a ^ b) <= max_distance, lambda fps, reps: _bucket_links(fps, reps, max_distance))


def _deal(rows: DataFrame, bucket_rows: int) -> DataFrame:
    """``rows`` (rep, fp, mask, value) sorted by bucket within partitions. A bucket of over ``bucket_rows`` rows is dealt into parts, and each pair of parts becomes a group of its own."""
    big = rows.groupBy("mask", "value").agg(F.count("*").alias("n")).where(F.col("n") > bucket_rows)
    big = materialize(big.select("mask", "value", F.ceil(F.col("n") / bucket_rows).cast("int").alias("parts")), "big-buckets")
    if big.isEmpty():
        dealt = rows.withColumn("part", F.lit(0).cast("long"))
    else:
        own = F.pmod(F.xxhash64("fp"), F.col("parts").cast("long"))
        other = F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)
        group = F.explode(F.transform(other, lambda o: F.least(o, F.col("own")) * F.col("parts") + F.greatest(o, F.col("own"))))
        dealt = rows.join(big, ["mask", "value"], "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("own", own).withColumn("part", group)
    return dealt.select("mask", "value", "part", *(c for c in rows.columns if c not in ("mask", "value"))).repartition("mask", "value", "part").sortWithinPartitions("mask", "value", "part")


def near_links(classes: DataFrame, max_distance: int = 3, extra: int = 2, bucket_rows: int = 4096) -> DataFrame:
    """Edges (u, v) between ``rep`` ids that connect all fingerprints ``fp`` within ``max_distance``.

    Within a bucket, each node is tied to the smallest it reaches there through
    checked pairs, so a dense bucket gives a row a node, not a row a pair. A
    bucket of over ``bucket_rows`` rows is dealt into parts, and each pair of
    parts becomes a group of its own: no group grows with the data and no pair
    is lost.
    """
    masks = [_signed(m) for m in _blocks(max_distance, extra)]
    rows = classes.select("rep", "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("mask", "value"))
    return _deal(rows, bucket_rows).mapInArrow(_links(max_distance), "u long, v long")


def near_duplicates(docs: DataFrame, width: int = 3, max_distance: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): groups of texts whose fingerprints chain within ``max_distance`` bits.

    component_id is the smallest doc_id reachable, its own included. Null and
    empty texts have fingerprint zero and link like any other. A row with a
    null doc_id takes part by its fingerprint, and ties what it is near to; if
    no id is in its group, its component is null. Repeated rows come back as
    often as they came; texts are read whole, whatever their length; an empty
    table gives no rows; columns but doc_id and text are not read.
    """
    with in_small_batches(docs.sparkSession):
        prints = materialize(fingerprints(docs, width), "fingerprints")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    classes = materialize(classes.select("fp", "first", F.monotonically_increasing_id().alias("rep")), "classes")
    found = connected_components(near_links(classes, max_distance, runs_beside(classes.count())))
    grouped = classes.join(found, classes.rep == found.node, "left").select("fp", "first", F.coalesce("component", "rep").alias("group"))
    least = grouped.groupBy("group").agg(F.min("first").alias("component_id"))
    of_class = materialize(grouped.join(least, "group").select("fp", "component_id"), "groups")
    return prints.join(of_class, "fp", "left").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The distinct hashes of a text's word shingles, sorted."""
    parts = list(shingle_hashes(text.encode(), width)) if text else []
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


_GOLD, _MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def long_print(hashes: np.ndarray, words: int) -> np.ndarray:
    """The bits (0 or 1) of a SimHash of ``words`` x 64 bits, each shingle counted once; without shingles all are zero, and of ties every second bit is one."""
    ones = np.zeros(words * BITS, np.int64)
    step = np.arange(1, words + 1, dtype=np.uint64) * _GOLD
    for at in range(0, len(hashes), 4096):
        z = hashes[at : at + 4096, None] + step
        z = (z ^ (z >> np.uint64(30))) * _MIX1
        z = (z ^ (z >> np.uint64(27))) * _MIX2
        z ^= z >> np.uint64(31)
        ones += np.unpackbits(z.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return (ones * 2 + np.arange(words * BITS) % 2 > len(hashes)).astype(np.uint8)


def block_plan(rows: int, similarity: float, recall: float, bucket_rows: int = 128) -> tuple[int, int]:
    """(bits of a block, number of blocks): unrelated texts share a block with about ``bucket_rows`` others, texts of the given Jaccard similarity some block with probability ``recall``."""
    agree = 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi
    bits = max(8, math.ceil(math.log2(max(1, rows) / bucket_rows)))
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree**bits)))


CHECKED_WORDS = 4


class _Drawn:
    """Sets of shingles of some texts, and which of them a set is similar to."""

    def __init__(self, sets: list[np.ndarray], similarity: float):
        self.sizes, self.similarity = np.array([len(x) for x in sets], np.int64), similarity
        every, of = np.concatenate([np.zeros(0, np.uint64), *sets]), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(every, kind="stable")
        self.every, self.of = every[order], of[order]

    def near(self, found: np.ndarray) -> list[int]:
        if not len(found) or not len(self.every):
            return []
        left, right = (np.searchsorted(self.every, found, side) for side in ("left", "right"))
        hit = right > left
        some = [self.of[a:b] for a, b in zip(left[hit], right[hit])]
        both = np.bincount(np.concatenate(some), minlength=len(self.sizes)) if some else np.zeros(len(self.sizes), np.int64)
        return np.flatnonzero((both > 0) & (both >= self.similarity * (self.sizes + len(found) - both) - 1e-9)).tolist()


def _draw(docs: DataFrame, n: int, width: int, similarity: float, most_bytes: int = 32_768) -> tuple[_Drawn, list[tuple]]:
    """Up to ``n`` distinct texts of at most ``most_bytes`` with the smallest hashes, whatever the table's order, to hold what is found against: their sets, and each one's (doc_id, hash)."""
    named = _named(docs).where(F.octet_length("text") <= most_bytes)
    names = named.select("doc_id", "hash").orderBy(F.xxhash64(F.lit("drawn"), "hash"), "doc_id").limit(n)  # without texts: each task sends as many
    picked = F.broadcast(docs.sparkSession.createDataFrame(names.collect(), "d long, h long"))
    rows = named.join(picked, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("hash") == F.col("h"))).select("doc_id", "hash", "text").dropDuplicates(["doc_id", "hash"]).orderBy("doc_id").collect()
    first = {r["hash"]: r for r in reversed(rows)}
    return _Drawn([shingle_set(r["text"], width) for r in first.values()], similarity), [(r["doc_id"], r["hash"]) for r in first.values()]


def _long_prints(docs: DataFrame, width: int, bits: int, blocks: int, drawn: _Drawn) -> DataFrame:
    """(doc_id, hash, fp, blocks, near): the first ``CHECKED_WORDS`` words of each whole text's long SimHash, the numbers of all its blocks, and of the drawn texts those that it is similar to."""
    words = max(CHECKED_WORDS, -(-bits * blocks // BITS))
    powers = 1 << np.arange(bits, dtype=np.int64)

    def run(batches):
        for b in batches:
            sets = [shingle_set(t.as_py(), width) for t in b.column(2)]
            prints = [long_print(x, words) for x in sets]
            rows = np.array(prints, np.uint8).reshape(len(prints), words * BITS)
            fps = np.packbits(rows[:, : CHECKED_WORDS * BITS], axis=1, bitorder="little")
            numbers = rows[:, : bits * blocks].reshape(len(rows), blocks, bits) @ powers
            lists = pa.FixedSizeListArray.from_arrays(pa.array(numbers.ravel()), blocks).cast(pa.list_(pa.int64()))
            near = pa.array([drawn.near(x) for x in sets], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in fps], pa.binary()), lists, near], ["doc_id", "hash", "fp", "blocks", "near"])

    return _named(docs).mapInArrow(run, "doc_id long, hash long, fp binary, blocks array<long>, near array<int>")


def _named(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"), text.alias("text"))


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def _near(a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    return _distance(a, b) <= limit


def bucket_tree(fps: np.ndarray, reps: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (u, v) within ``limit`` bits that connect all rows of a bucket which such pairs connect: a spanning tree of the nearest pairs, so that the likeliest are verified first."""
    order = np.argsort(reps, kind="stable")
    fps, reps = fps[order], reps[order]
    n, strip = len(reps), max(1, (1 << 18) // len(reps))
    some = np.concatenate([_near(fps[a : a + strip, None], fps[None], limit).sum(1) > 1 for a in range(0, n, strip)])
    left = np.flatnonzero(some)
    near, parent = np.full(len(left), limit + 1), np.zeros(len(left), np.int64)
    us, vs = [], []
    while len(left):
        k = int(near.argmin())
        node = left[k]
        if near[k] <= limit:
            us.append(node)
            vs.append(parent[k])
        left, near, parent = (np.delete(x, k) for x in (left, near, parent))
        far = _distance(fps[node], fps[left])
        closer = far < near
        near[closer], parent[closer] = far[closer], node
    u, v = reps[np.array(us, np.int64)], reps[np.array(vs, np.int64)]
    return np.maximum(u, v), np.minimum(u, v)


def crossing_pairs(fps: np.ndarray, reps: np.ndarray, groups: np.ndarray, tried: list, limit: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (u, v) of a bucket within ``limit`` bits that lie in different groups and are not in ``tried``: of each row outside of the largest group the ``most`` nearest."""
    names, of, size = np.unique(groups, return_inverse=True, return_counts=True)
    rows = np.flatnonzero(of != size.argmax()) if len(names) > 1 else np.zeros(0, np.int64)
    us, vs, strip = [], [], max(1, (1 << 18) // len(reps))
    for a in range(0, len(rows), strip):
        mine = rows[a : a + strip]
        far = _distance(fps[mine, None], fps[None])
        far[of[mine][:, None] == of[None]] = limit + 1
        for i, distance in zip(mine[(far <= limit).any(1)], far[(far <= limit).any(1)]):
            near = np.flatnonzero(distance <= limit)
            near = near[np.argsort(distance[near], kind="stable")]
            if tried[i]:
                near = near[~np.isin(reps[near], tried[i])]
            us.append(np.full(len(near[:most]), reps[i]))
            vs.append(reps[near[:most]])
    u, v = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (us, vs))
    return np.maximum(u, v), np.minimum(u, v)


def _crossing(limit: int, most: int):
    """`crossing_pairs` of each bucket of rows sorted by bucket; one may go over several batches."""

    def run(batches):
        held: list = []

        def pairs():
            t = pa.Table.from_batches(held)
            held.clear()
            if len(t) < 2:
                return
            u, v = crossing_pairs(_prints(t.column("fp")), t.column("rep").to_numpy(), t.column("group").to_numpy(), t.column("tried").to_pylist(), limit, most)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        last = None
        for b in batches:
            keys = np.stack([b.column(k).to_numpy() for k in ("mask", "value", "part")], 1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for a, e in zip([0, *cuts], [*cuts, len(b)]):
                if last is not None and (keys[a] != last).any():
                    yield from pairs()
                last = keys[a]
                held.append(b.slice(a, e - a))
        if held:
            yield from pairs()

    return run


def _checked(width: int, similarity: float):
    """Pairs with their texts to (u, v, similar): whether their sets of shingles are similar enough; texts without shingles are alike."""

    def run(batches):
        last, mine = None, None
        for b in batches:
            similar = []
            for v, a, c in zip(b.column("v").to_pylist(), b.column("u_text"), b.column("v_text")):
                if v != last:  # rows come sorted by v
                    last, mine = v, shingle_set(c.as_py(), width)
                other = shingle_set(a.as_py(), width)
                both = len(np.intersect1d(mine, other, assume_unique=True))
                similar.append(both >= similarity * (len(mine) + len(other) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v"), pa.array(similar, pa.bool_())], ["u", "v", "similar"])

    return run


def _check(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """(u, v, similar), written, of pairs whose texts are in ``texts`` (rep, text)."""
    both = pairs.join(texts.select(F.col("rep").alias("u"), F.col("text").alias("u_text")), "u").join(texts.select(F.col("rep").alias("v"), F.col("text").alias("v_text")), "v")
    both = both.select("u", "v", "u_text", "v_text").sortWithinPartitions("v")
    with in_small_batches(pairs.sparkSession, 64):  # rows of two whole texts, those of one long text together
        return materialize(both.mapInArrow(_checked(width, similarity), "u long, v long, similar boolean"), "checked")


def _grouped(classes: DataFrame, links: DataFrame) -> DataFrame:
    """``classes`` with ``group``, the smallest rep that the links lead to."""
    found = connected_components(links)
    return classes.join(found, classes.rep == found.node, "left").withColumn("group", F.coalesce("component", "rep")).drop("node", "component")


def _far(bits: int, similarity: float) -> int:
    """How many of ``bits`` may differ at a similarity, with 2.5 standard deviations more."""
    agree = 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(bits * (1 - agree) + 2.5 * math.sqrt(bits * agree * (1 - agree)))


LONG_WORDS = 16


def _longer(texts: DataFrame, width: int) -> DataFrame:
    """(rep, fp): prints of ``LONG_WORDS`` words, by which few pairs below the limit pass for near."""

    def run(batches):
        for b in batches:
            fps = [np.packbits(long_print(shingle_set(t.as_py(), width), LONG_WORDS), bitorder="little").tobytes() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("rep"), pa.array(fps, pa.binary())], ["rep", "fp"])

    return texts.select("rep", "text").mapInArrow(run, "rep long, fp binary")


def _between(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """(u, v): the different groups that ``pairs`` lie in, of ``groups`` (rep, group)."""
    of = lambda c: groups.select(F.col("rep").alias(c), F.col("group").alias(f"{c}_group"))
    both = pairs.select("u", "v").join(of("u"), "u").join(of("v"), "v").where("u_group <> v_group")
    return both.select(F.greatest("u_group", "v_group").alias("u"), F.least("u_group", "v_group").alias("v")).distinct()


def _tied_groups(classes: DataFrame, checked: DataFrame, texts: DataFrame, bucket_rows: int, width: int, similarity: float) -> DataFrame:
    """``classes`` with ``group``: by the links of ``checked``, the pairs of the buckets' trees, and by more until no bucket has a near pair between groups that was not checked.

    Where every pair of a tree is a link, all that is near is tied. What hangs
    together by pairs of trees, but not by links, is looked at again, and
    nothing else: these are the groups at either end of a pair that is no link.
    Their nearest pairs between groups are checked, each round twice
    as many of a row, and groups that become one need no more pairs. Which are
    near is told by longer prints here, so that few fail. A round ties groups,
    by its new links alone; nothing that was tied is gone through again.
    """
    own = materialize(_grouped(classes, checked.where("similar").select("u", "v")), "own")
    apart = _between(checked.where("not similar"), own)
    torn = materialize(apart.select(F.explode(F.array("u", "v")).alias("group")).distinct(), "torn")
    left = own.join(torn, "group", "left_semi").select("rep", "blocks", F.col("group").alias("own"))
    with in_small_batches(classes.sparkSession):
        prints = materialize(_longer(texts.join(left.select("rep"), "rep", "left_semi"), width), "longer")
    left = materialize(left.join(prints, "rep"), "left")
    merged = torn.select(F.col("group").alias("own"), "group")
    limit, most = _far(LONG_WORDS * BITS, similarity), 8
    while True:
        pairs = checked.where("not similar")
        tried = pairs.union(pairs.select("v", "u", "similar")).groupBy("u").agg(F.collect_list("v").alias("tried")).withColumnRenamed("u", "rep")
        now = left.join(merged, "own")
        rows = now.join(tried, "rep", "left").select("rep", "fp", "group", "tried", F.posexplode("blocks").alias("mask", "value"))
        rows = materialize(rows, "rows")
        found = _deal(rows, bucket_rows).mapInArrow(_crossing(limit, most), "u long, v long").distinct()
        found = materialize(found, "crossing")
        if found.isEmpty():
            moved = merged.select(F.col("own").alias("group"), F.col("group").alias("tied"))
            return own.join(moved, "group", "left").withColumn("group", F.coalesce("tied", "group")).drop("tied")
        more = _check(found, texts, width, similarity)
        checked = checked.unionByName(more)
        components = connected_components(_between(more.where("similar"), now.select("rep", "group")))
        merged = merged.join(components, merged.group == components.node, "left").select("own", F.coalesce("component", "group").alias("group"))
        merged = materialize(merged, "merged")
        most *= 2


def similar_texts(docs: DataFrame, width: int = 5, similarity: float = 0.8, recall: float = 0.99, bucket_rows: int = 4096, drawn: int = 256) -> DataFrame:
    """(doc_id, hash, copies, group): every distinct document (id and text hash) with the group that it is in.

    Groups are chains of pairs whose sets of ``width``-word shingles have a
    Jaccard similarity of ``similarity`` or more. A pair at the limit shares one
    of the blocks with probability ``recall``, a closer one nearly always, and
    passes the Hamming check of 256 bits but for one in two hundred at the limit. All
    pairs that do are verified by their whole sets of shingles, but for those
    that other links tie. Texts with equal fingerprints of all blocks, as copies
    are, go as one. Null and empty texts are alike.

    ``drawn`` distinct texts are held against all others besides; the share of
    their similar texts that came to their groups is logged.
    """
    bits, blocks = block_plan(docs.count(), similarity, recall)
    sets, names = _draw(docs, drawn, width, similarity)
    with in_small_batches(docs.sparkSession):
        prints = materialize(_long_prints(docs, width, bits, blocks, sets), "prints")
    member = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")
    distinct = prints.groupBy("doc_id", "hash", "fp", "blocks").agg(F.count("*").alias("copies"))
    classes = distinct.groupBy("fp", "blocks").agg(F.min(member).alias("m"))
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("rep"), "fp", "blocks", "m.doc_id", "m.hash"), "classes")
    limit = _far(CHECKED_WORDS * BITS, similarity)
    rows = classes.select("rep", "fp", F.posexplode("blocks").alias("mask", "value"))
    near = _by_bucket(lambda a, b: _near(a, b, limit), lambda fps, reps: bucket_tree(fps, reps, limit))
    pairs = materialize(_deal(rows, bucket_rows).mapInArrow(near, "u long, v long").distinct(), "pairs")
    asked = pairs.select(F.col("u").alias("rep")).union(pairs.select(F.col("v").alias("rep"))).distinct()
    asked = materialize(classes.join(asked, "rep", "left_semi").select("rep", F.col("doc_id").alias("d"), F.col("hash").alias("h")), "asked")
    named = _named(docs)
    # texts are dealt the same way at every size: what is asked for grows with the documents
    texts = named.join(asked.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("hash") == F.col("h"))).select("rep", "text")
    texts = materialize(texts.groupBy("rep").agg(F.first("text").alias("text")), "texts")
    grouped = _tied_groups(classes, _check(pairs, texts, width, similarity), texts, bucket_rows, width, similarity).select("fp", "blocks", "group")
    out = materialize(distinct.join(grouped, ["fp", "blocks"]).select("doc_id", "hash", "copies", "group"), "similar")
    share, n = _audit(prints, out, names)
    log.info("near copies: %s of %d similar pairs with one of %d drawn texts are in one group", share, n, len(names))
    return out


def _audit(prints: DataFrame, out: DataFrame, names: list[tuple]) -> tuple[float | None, int]:
    """(share, number): of the pairs of a drawn text and another similar one, how many are in one group."""
    drawn = F.broadcast(prints.sparkSession.createDataFrame([(k, *name) for k, name in enumerate(names)], "near int, d long, h long"))
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("hash") == F.col("h"))
    wanted = out.join(drawn, same).select("near", "d", "h", F.col("group").alias("wanted"))
    pairs = prints.select(F.col("doc_id").alias("i"), F.col("hash").alias("t"), F.explode("near").alias("near")).distinct()
    both = pairs.join(out, F.col("i").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("hash"))).join(F.broadcast(wanted), "near").where(~same)
    row = both.agg(F.count("*").alias("n"), F.avg((F.col("group") == F.col("wanted")).cast("double")).alias("share")).first()
    return row["share"], row["n"]


def keep_one(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group of ``similar_texts`` the document with the smallest id stays.

    Documents without an id come last, equal ids by their text's hash; of
    repeated rows (id and text) one stays. Null and empty texts are copies of
    one another. Texts are dealt by id once, at every size: the ids that stay
    grow with the documents and are never broadcast. An empty table gives no
    rows; other columns are kept as they are.
    """
    near = similar_texts(docs, width, similarity)
    first = near.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash", "copies")).alias("m"))
    first = materialize(first.select(F.col("m.doc_id").alias("__id"), F.col("m.hash").alias("__h"), F.col("m.copies").alias("__copies")), "kept")
    hashed = docs.withColumn("__hash", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    kept = hashed.join(first.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__h")), "left_semi")
    if not first.where("__copies > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", "__hash"])
    return kept.select(docs.columns)
