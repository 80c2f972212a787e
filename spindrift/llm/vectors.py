"""Embedding near-duplicates by a robust-pruned flat graph over overlapping cluster shards."""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import connected_components

NONE = -1
_SHARD = ("dims", "cluster", "i", "j")
#: Clusters that a split makes at most; a cluster's number is its parent's times this and its place.
_FAN = 512


def unit_rows(rows: list) -> np.ndarray:
    """Rows scaled to length one, in double precision; the largest component first, so that squares stay finite."""
    return _unit(np.array(rows, np.float64))


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The unit rows of a column of vectors, all of one length."""
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    flat = np.concatenate([p.flatten().to_numpy(zero_copy_only=False) for p in parts])
    return _unit(flat.reshape(len(column), -1))


def robust_prune(x: np.ndarray, points: np.ndarray, cand: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """For each point, at most ``degree`` of its candidates (ids, NONE for none): the nearest first, without those that a chosen one is ``alpha`` times nearer to."""
    m = len(points)
    cand = np.sort(np.where(cand == points[:, None], NONE, cand), axis=1)
    cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = NONE
    vec = x[cand]
    far = np.maximum(0, 2 - 2 * np.matmul(vec, x[points][:, :, None])[:, :, 0])
    far[cand == NONE] = np.inf
    between = np.maximum(0, 2 - 2 * np.matmul(vec, vec.transpose(0, 2, 1))) * (alpha * alpha)
    out, rows = np.full((m, degree), NONE), np.arange(m)
    left = far.copy()
    for k in range(degree):
        best = left.argmin(1)
        good = np.isfinite(left[rows, best])
        if not good.any():
            break
        out[good, k] = cand[rows, best][good]
        left[(between[rows, best] <= far) & good[:, None]] = np.inf
        left[rows, best] = np.inf
    return out


def medoids(x: np.ndarray, count: int) -> np.ndarray:
    """The point nearest to the mean, then points far from those chosen."""
    out = [int((x @ x.mean(0)).argmax())]
    near = x @ x[out[0]]
    for _ in range(min(count, len(x)) - 1):
        out.append(int(near.argmin()))
        near = np.maximum(near, x @ x[out[-1]])
    return np.unique(out)


def build_graph(x: np.ndarray, degree: int = 24, near: int = 48, shortcuts: int = 4, alpha: float = 1.2, batch: int = 256, seed: int = 1) -> np.ndarray:
    """Adjacency (n x ids, NONE for none) of a robust-pruned graph.

    The candidates of a point are its ``near`` nearest of the shard; what is
    left of them by pruning gets the way back, and is pruned again to ``degree``
    ids. ``shortcuts`` more ids, drawn at random, lead out of dense groups.
    """
    n = len(x)
    if n <= degree + 1:
        full = np.tile(np.arange(n), (n, 1))
        return full[~np.eye(n, dtype=bool)].reshape(n, n - 1) if n > 1 else np.full((n, 1), NONE)
    x = x.astype(np.float32)
    near, first = min(near, n - 1), (2 * degree + 2) // 3
    once = np.empty((n, first), np.int64)
    for at in range(0, n, batch):
        points = np.arange(at, min(n, at + batch))
        s = x[points] @ x.T
        s[np.arange(len(points)), points] = -np.inf
        once[points] = robust_prune(x, points, np.argpartition(-s, near - 1, axis=1)[:, :near], alpha, first)
    src, dst = np.repeat(np.arange(n), first), once.ravel()
    src, dst = src[dst != NONE], dst[dst != NONE]
    order = np.random.default_rng(seed).permutation(len(dst))  # of very many ways back, any
    order = order[np.argsort(dst[order], kind="stable")]
    src, dst = src[order], dst[order]
    size = np.bincount(dst, minlength=n)
    col = np.arange(len(dst)) - np.repeat(np.cumsum(size) - size, size)
    back = np.full((n, degree), NONE)
    ok = col < degree
    back[dst[ok], col[ok]] = src[ok]
    out = np.empty((n, degree + shortcuts), np.int64)
    for at in range(0, n, batch):
        points = np.arange(at, min(n, at + batch))
        out[points, :degree] = robust_prune(x, points, np.concatenate([once[points], back[points]], 1), alpha, degree)
    out[:, degree:] = np.random.default_rng(seed + 1).integers(0, n, (n, shortcuts))
    out[out == np.arange(n)[:, None]] = NONE
    return out


def greedy_search(x: np.ndarray, graph: np.ndarray, queries: np.ndarray, entries: np.ndarray, beam: int):
    """Best-first search of all ``queries`` (rows of x) at once, from ``entries`` and the query's own place; gives the nodes seen (bool matrix)."""
    m, n = len(queries), len(x)
    seen = np.zeros((m, n), bool)
    seen[:, entries] = True
    seen[np.arange(m), queries] = True
    q = x[queries]
    first = np.concatenate([np.broadcast_to(entries, (m, len(entries))), queries[:, None]], 1)
    sims = np.einsum("mrd,md->mr", x[first], q)
    beam = max(beam, first.shape[1])
    ids = np.concatenate([first, np.full((m, beam - first.shape[1]), NONE)], 1)
    sims = np.concatenate([sims, np.full((m, beam - sims.shape[1]), -np.inf)], 1)
    done, live = np.zeros((m, beam), bool), np.arange(m)
    while len(live):
        todo = np.where(done[live] | (ids[live] == NONE), -np.inf, sims[live])
        at = todo.argmax(1)
        going = np.isfinite(todo[np.arange(len(live)), at])
        live, at = live[going], at[going]
        if not len(live):
            break
        done[live, at] = True
        near = graph[ids[live, at]]
        fresh = (near != NONE) & ~seen[live[:, None], near]
        seen[np.broadcast_to(live[:, None], near.shape)[fresh], near[fresh]] = True
        s = np.where(fresh, np.matmul(x[near], q[live][:, :, None])[:, :, 0], -np.inf)
        all_ids, all_sims = np.concatenate([ids[live], near], 1), np.concatenate([sims[live], s], 1)
        all_done = np.concatenate([done[live], np.zeros(near.shape, bool)], 1)
        top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        ids[live], sims[live], done[live] = (np.take_along_axis(a, top, 1) for a in (all_ids, all_sims, all_done))
        ids[live] = np.where(np.isfinite(sims[live]), ids[live], NONE)
    return seen


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unite the groups of each pair; ``label`` holds a member of each node's group, the smallest, and is changed in place."""
    while True:
        lo, hi = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        apart = lo < hi
        if not apart.any():
            return
        np.minimum.at(label, hi[apart], lo[apart])
        while (label[label] != label).any():
            label[:] = label[label]


def range_groups(x: np.ndarray, graph: np.ndarray, entries: np.ndarray, beam: int, threshold: float, batch: int = 256) -> np.ndarray:
    """For each node the smallest one it reaches over pairs found with a cosine of ``threshold`` or more.

    Every node is a query: greedy search, then spreading from what is near
    enough, over its neighbours that are not of the query's group yet.
    """
    n, walk = len(x), x.astype(np.float32)
    label = np.arange(n)
    for a in range(0, n, batch):
        queries = np.arange(a, min(n, a + batch))
        seen = greedy_search(walk, graph, queries, entries, beam)
        q, node = np.nonzero(seen)
        hit = _at_least(x, queries[q], node, threshold)
        q, node = q[hit], node[hit]
        while len(q):
            merge(label, queries[q], node)
            mark = np.zeros_like(seen)
            step = max(1, (1 << 21) // graph.shape[1])
            for at in range(0, len(q), step):
                near = graph[node[at : at + step]]
                who = np.broadcast_to(q[at : at + step, None], near.shape)
                new = (near != NONE) & (label[near] != label[queries[who]])
                mark[who[new], near[new]] = True
            mark &= ~seen
            seen |= mark
            q, node = np.nonzero(mark)
            hit = _at_least(x, queries[q], node, threshold)
            q, node = q[hit], node[hit]
    return label


def _at_least(x: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """The check of each pair, in double precision."""
    out = np.empty(len(a), bool)
    for at in range(0, len(a), 1 << 16):
        out[at : at + (1 << 16)] = np.einsum("pd,pd->p", x[a[at : at + (1 << 16)]], x[b[at : at + (1 << 16)]]) >= threshold
    return out


def _kmeans(x: np.ndarray, k: int, steps: int = 6, seed: int = 3) -> np.ndarray:
    centre = x[np.sort(np.random.default_rng(seed).choice(len(x), k, replace=False))].copy()
    for _ in range(steps):
        own = (x @ centre.T).argmax(1)
        order = np.argsort(own, kind="stable")
        size = np.bincount(own, minlength=k)
        some = np.flatnonzero(size)
        mean = np.add.reduceat(x[order], (np.cumsum(size) - size)[some], axis=0)
        norm = np.linalg.norm(mean, axis=1, keepdims=True)
        centre[some] = np.where(norm > 0, mean / np.maximum(norm, 1e-300), centre[some])
    return centre


def _fit(shard_rows: int, seed: int):
    """A cluster's sample to the centres of its parts."""

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("rep").to_numpy(), kind="stable")
        x = _matrix(table.column("vector"))[order]
        k = min(_FAN - 1, len(x), max(2, int(-(-5 * table.column("size")[0].as_py() // (2 * shard_rows)))))
        centre = _kmeans(x, k, seed=seed)
        return pa.table({"dims": table.column("dims").slice(0, 1), "cluster": table.column("cluster").slice(0, 1), "centres": pa.array([centre.ravel()], pa.list_(pa.float64()))})

    return run


def _assign(margin: float, most: int):
    """Rows of a cluster and its centres to a row for each part: the two nearest, and others as near but for ``margin``."""

    def run(rows: pa.Table, centres: pa.Table) -> pa.Table:
        schema = pa.schema([("rep", pa.int64()), ("vector", pa.list_(pa.float64())), ("dims", pa.int64()), ("cluster", pa.int64()), ("parent", pa.int64())])
        if not len(rows):
            return schema.empty_table()
        x = _matrix(rows.column("vector"))
        c = centres.column("centres")[0].values.to_numpy().reshape(-1, x.shape[1])
        s = x @ c.T
        top = np.argsort(-s, axis=1, kind="stable")[:, :most]
        best = np.take_along_axis(s, top, 1)
        inside = best >= best[:, :1] - margin
        inside[:, :2] = True
        at, col = np.nonzero(inside)
        taken = rows.take(pa.array(at))
        cluster = taken.column("cluster").to_numpy() * _FAN + top[at, col] + 1
        return pa.table([taken.column("rep"), taken.column("vector"), taken.column("dims"), pa.array(cluster), taken.column("size")], schema=schema)

    return run


def place(classes: DataFrame, shard_rows: int, margin: float, overlap: int, sample_rows: int, seed: int) -> DataFrame:
    """A row for each cluster a vector is in (rep, vector, dims, cluster), in clusters of at most twice ``shard_rows`` vectors, where they can be split.

    A larger cluster is split by centres of its own, fitted on at most about
    ``sample_rows`` of its vectors, drawn by hash, again and again. One that
    stays nearly as large, as its vectors have nearly one direction, is left.
    """
    rows = classes.select("rep", "vector", F.col("dims").cast("long").alias("dims"), F.lit(0).cast("long").alias("cluster"), F.lit(None).cast("long").alias("parent"))
    key = ["dims", "cluster"]
    done = None
    while True:
        sizes = rows.groupBy(*key).agg(F.count("*").alias("size"), F.max("parent").alias("__parent"))
        big = materialize(sizes.where((F.col("size") > 2 * shard_rows) & (F.col("__parent").isNull() | (F.col("size") < 0.9 * F.col("__parent")))).select(*key, "size"), "clusters")
        if big.isEmpty():
            return rows.drop("parent") if done is None else done.unionByName(rows.drop("parent"))
        small = rows.join(big, key, "left_anti").drop("parent")
        done = small if done is None else done.unionByName(small)
        large = rows.drop("parent").join(big, key)
        draw = F.ceil(F.col("size") / F.least(F.lit(sample_rows), F.greatest(F.lit(1000), F.col("size") * 100 / shard_rows)))
        sample = large.where(F.pmod(F.xxhash64(F.lit(seed), "rep"), draw) == 0)
        centres = sample.groupBy(*key).applyInArrow(_fit(shard_rows, seed), "dims long, cluster long, centres array<double>")
        chunks = F.ceil(F.col("size") * F.col("dims") / (1 << 20))
        each = materialize(centres, "centres").join(big, key).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1))).select(*key, "chunk", "centres")
        dealt = large.withColumn("chunk", F.pmod(F.xxhash64("rep"), chunks)).select(*key, "chunk", "rep", "vector", "size")
        split = dealt.groupBy(*key, "chunk").cogroup(each.groupBy(*key, "chunk")).applyInArrow(_assign(margin, overlap), "rep long, vector array<double>, dims long, cluster long, parent long")
        rows = materialize(split, "split")


def _shards(placed: DataFrame, shard_rows: int) -> DataFrame:
    """A row for each shard a vector is in. A cluster of over twice ``shard_rows`` vectors that can't be split is dealt into salts, and each pair of salts is a shard."""
    sizes = placed.groupBy("dims", "cluster").agg(F.ceil(F.count("*") / (2 * shard_rows)).alias("salts"))
    rows = placed.join(sizes, ["dims", "cluster"]).withColumn("salt", F.pmod(F.xxhash64("rep"), F.col("salts")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    return rows.select("rep", "vector", "dims", "cluster", F.least("salt", "other").alias("i"), F.greatest("salt", "other").alias("j"))


def _local(table: pa.Table):
    rep = table.column("rep").to_numpy()
    order = np.argsort(rep, kind="stable")
    return order, rep[order], _matrix(table.column("vector"))[order]


def _build(degree: int, reach: float):
    def run(table: pa.Table) -> pa.Table:
        _, rep, x = _local(table)
        graph = build_graph(x, degree)
        at, col = np.nonzero(graph != NONE)
        to = graph[at, col]
        return pa.table({"src": rep[at], "dst": rep[to], "close": _at_least(x, at, to, reach)})

    return run


def _search(threshold: float, beam: int):
    def run(table: pa.Table) -> pa.Table:
        order, rep, x = _local(table)
        n = len(rep)
        near = table.column("near").combine_chunks().take(pa.array(order))
        flat, size = near.flatten().to_numpy(), near.value_lengths().fill_null(0).to_numpy()
        at = np.minimum(np.searchsorted(rep, flat), n - 1)
        here = rep[at] == flat  # ways to other shards are gone by `across`
        src, dst = np.repeat(np.arange(n), size)[here], at[here]
        degrees = np.bincount(src, minlength=n)
        graph = np.full((n, max(1, int(degrees.max(initial=0)))), NONE)
        graph[src, np.arange(len(src)) - np.repeat(np.cumsum(degrees) - degrees, degrees)] = dst
        label = range_groups(x, graph, medoids(x, 8), beam, threshold)
        tied = np.flatnonzero(label != np.arange(n))
        return pa.table({"u": rep[tied], "v": rep[label[tied]]})

    return run


def _links_of(threshold: float):
    """Pairs with both vectors to those near enough."""

    def run(batches):
        for b in batches:
            if not len(b):
                continue
            dims = b.column("x_vector").value_lengths().to_numpy()
            for d in np.unique(dims):
                rows = b.filter(pa.array(dims == d))
                hit = np.einsum("pd,pd->p", _matrix(rows.column("x_vector")), _matrix(rows.column("y_vector"))) >= threshold
                yield rows.select(["u", "v"]).filter(pa.array(hit))

    return run


def across(union: DataFrame, classes: DataFrame, component: DataFrame, threshold: float) -> DataFrame:
    """Links (u, v) found on the united graph between groups that no shard has tied: those of each node and its close neighbours that are of different groups."""
    around = union.where(F.size("close") > 0).select(F.col("src").alias("b"), F.explode(F.array_union(F.array("src"), "close")).alias("node"))
    named = around.join(component, "node", "left").select("b", F.struct("node", F.coalesce("component", "node").alias("group")).alias("m"))
    mixed = named.groupBy("b").agg(F.collect_list("m").alias("ms"), F.min("m.group").alias("lo"), F.max("m.group").alias("hi")).where("lo <> hi")
    pairs = mixed.select(F.explode("ms").alias("x"), "ms").select("x", F.explode("ms").alias("y")).where("x.node < y.node and x.group <> y.group")
    pairs = pairs.select(F.col("x.node").alias("u"), F.col("y.node").alias("v")).distinct()
    x = classes.select(F.col("rep").alias("u"), F.col("vector").alias("x_vector"))
    y = classes.select(F.col("rep").alias("v"), F.col("vector").alias("y_vector"))
    return pairs.join(x, "u").join(y, "v").select("u", "v", "x_vector", "y_vector").mapInArrow(_links_of(threshold), "u long, v long")


def _graph_round(classes: DataFrame, threshold: float, shard_rows: int, margin: float, overlap: int, degree: int, beam: int, reach: float, sample_rows: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The united adjacency lists of one clustering, and the ties (u, v) found by its shards."""
    shards = materialize(_shards(place(classes, shard_rows, margin, overlap, sample_rows, seed), shard_rows), "shards")
    edges = shards.groupBy(*_SHARD).applyInArrow(_build(degree, reach), "src long, dst long, close boolean")
    near = F.array_sort(F.collect_set("dst"))
    union = materialize(edges.groupBy("src").agg(near.alias("near"), F.collect_set(F.when(F.col("close"), F.col("dst"))).alias("close")), "graph")
    ready = shards.join(union.select("src", "near"), shards.rep == union.src, "left").drop("src")
    return union, materialize(ready.groupBy(*_SHARD).applyInArrow(_search(threshold, beam), "u long, v long"), "ties")


def _count(threshold: float):
    """Links of each vector with others of its component, exactly; a table holds whole components."""

    def run(table: pa.Table) -> pa.Table:
        component = table.column("component").to_numpy()
        lengths = table.column("vector").combine_chunks().value_lengths().to_numpy()
        order = np.lexsort((lengths, component))
        table = table.take(pa.array(order))
        component, n = component[order], table.column("n").to_numpy()
        cut = np.flatnonzero(component[1:] != component[:-1]) + 1
        links = np.zeros(len(n), np.int64)
        for a, b in zip(np.r_[0, cut], np.r_[cut, len(n)]):
            x = _matrix(table.column("vector").slice(a, b - a))
            for at in range(a, b, 1024):
                hit = x[at - a : at - a + 1024] @ x.T >= threshold
                hit[np.arange(len(hit)), np.arange(at - a, at - a + len(hit))] = False
                links[at : at + len(hit)] = hit @ n[a:b]
        return pa.table({"rep": table.column("rep"), "links": links})

    return run


def _sum_of(table: pa.Table) -> pa.Table:
    """The sum of unit vectors."""
    return pa.table({"component": table.column("component").slice(0, 1), "middle": pa.array([_matrix(table.column("vector")).sum(0)], pa.list_(pa.float64()))})


def _in_core(threshold: float):
    """Whether a vector is within half the angle of the threshold of its group's middle, so that any two such are linked."""
    half = np.cos(np.arccos(threshold) / 2) + 1e-9

    def run(batches):
        for b in batches:
            core = np.zeros(len(b), bool)
            lengths = b.column("vector").value_lengths().to_numpy()
            for d in np.unique(lengths):
                at = np.flatnonzero(lengths == d)
                rows = b.take(pa.array(at))
                middle = np.stack([m for m in rows.column("middle").to_numpy(zero_copy_only=False)])
                norm = np.linalg.norm(middle, axis=1)
                core[at] = np.einsum("pd,pd->p", _matrix(rows.column("vector")), middle) >= half * np.maximum(norm, 1e-300)
            yield pa.RecordBatch.from_arrays([*b.select(["rep", "vector", "n", "component"]).columns, pa.array(core)], ["rep", "vector", "n", "component", "core"])

    return run


def _count_outer(threshold: float):
    """Links of the outer vectors of a task (``side``) with the others of it: rows for both ends, but for outer ones, which have theirs from their own side."""

    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy(zero_copy_only=False).astype(bool)
        outer, others = table.filter(pa.array(side)), table.filter(pa.array(~side))
        if not len(outer) or not len(others):
            return pa.table({"rep": pa.array([], pa.int64()), "links": pa.array([], pa.int64())})
        x, y = _matrix(outer.column("vector")), _matrix(others.column("vector"))
        rep, other, core = outer.column("rep").to_numpy(), others.column("rep").to_numpy(), others.column("core").to_numpy(zero_copy_only=False).astype(bool)
        mine, theirs = np.zeros(len(rep), np.int64), np.zeros(len(other), np.int64)
        for at in range(0, len(rep), 1024):
            hit = (x[at : at + 1024] @ y.T >= threshold) & (rep[at : at + 1024, None] != other[None, :])
            mine[at : at + 1024] = hit @ others.column("n").to_numpy()
            theirs += outer.column("n").to_numpy()[at : at + 1024] @ hit
        return pa.table({"rep": np.r_[rep, other[core]], "links": np.r_[mine, theirs[core]]})

    return run


def count_links(named: DataFrame, threshold: float, rows: int = 8192) -> DataFrame:
    """(rep, links): each vector of a group compared with all others of its group (rep, vector, n, component).

    Small groups go together into tasks of about ``rows`` vectors. Of a group
    of over ``rows``, the vectors within half the threshold's angle of its middle
    are all linked with one another, so they are counted by one number; the
    outer ones are compared with all in blocks of ``rows``. A hot group of near
    copies so costs its outer vectors times its size, not the square of it.
    """
    sizes = named.groupBy("component").agg(F.count("*").alias("size")).where("size > 1")
    sizes = materialize(sizes, "sizes")
    some = named.join(sizes, "component")
    buckets = F.lit(max(1, -(-(sizes.where(F.col("size") <= rows).agg(F.sum("size")).first()[0] or 0) // rows)))
    small = some.where(F.col("size") <= rows).withColumn("bucket", F.pmod(F.xxhash64("component"), buckets))
    counted = small.select("rep", "vector", "n", "component", "bucket").groupBy("bucket").applyInArrow(_count(threshold), "rep long, links long")
    if sizes.where(F.col("size") > rows).isEmpty():
        return counted
    large = some.where(F.col("size") > rows)
    chunk = F.pmod(F.xxhash64("rep"), F.ceil(F.col("size") / rows))
    sums = large.select("component", "vector", chunk.alias("chunk")).groupBy("component", "chunk").applyInArrow(_sum_of, "component long, middle array<double>")
    middle = sums.select("component", F.col("middle").alias("vector")).groupBy("component").applyInArrow(_total, "component long, middle array<double>")
    large = materialize(large.join(middle, "component").select("rep", "vector", "n", "component", "middle").mapInArrow(_in_core(threshold), "rep long, vector array<double>, n long, component long, core boolean"), "large")
    figures = large.groupBy("component").agg(F.sum(F.when(F.col("core"), F.col("n")).otherwise(0)).alias("core_n"), F.ceil(F.count_if(~F.col("core")) / rows).alias("outers"), F.ceil(F.count("*") / rows).alias("parts"))
    large = large.join(figures, "component")
    inside = large.where("core").select("rep", (F.col("core_n") - F.col("n")).alias("links"))
    salt = lambda count: F.pmod(F.xxhash64("rep"), F.greatest(count, F.lit(1)))
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), count - 1))
    columns = ["component", "i", "j", "rep", "vector", "n", "core", "side"]
    outer = large.where("not core").withColumn("i", salt(F.col("outers"))).withColumn("j", every(F.col("parts"))).withColumn("side", F.lit(True))
    others = large.where("outers > 0").withColumn("j", salt(F.col("parts"))).withColumn("i", every(F.col("outers"))).withColumn("side", F.lit(False))
    checked = outer.select(*columns).union(others.select(*columns)).groupBy("component", "i", "j").applyInArrow(_count_outer(threshold), "rep long, links long")
    return counted.union(inside.union(checked).groupBy("rep").agg(F.sum("links").alias("links")))


def _total(table: pa.Table) -> pa.Table:
    """The sum of a group's few sums."""
    flat = np.concatenate([c.flatten().to_numpy() for c in table.column("vector").chunks]).reshape(len(table), -1)
    return pa.table({"component": table.column("component").slice(0, 1), "middle": pa.array([flat.sum(0)], pa.list_(pa.float64()))})


def audit(named: DataFrame, threshold: float, queries: int, links: int = 64) -> float | None:
    """Share of the true links of some vectors, drawn by hash and compared with all, whose ends are in one group; None if they have no link. As long as they have fewer than ``links``, more are drawn, up to 16 times ``queries``."""
    rows, most = named.count(), 16 * queries
    while True:
        true, found = _audited(named, threshold, max(1, -(-rows // queries)), 4 * queries)
        if true >= links or queries >= min(rows, most):
            return found / true if true else None
        queries *= 4


def _audited(named: DataFrame, threshold: float, step: int, limit: int) -> tuple[int, int]:
    """(true, found): links of every ``step``-th vector by hash, and how many are within groups."""
    drawn = named.where(F.pmod(F.xxhash64(F.lit("audit"), "rep"), F.lit(step)) == 0).select("rep", "vector", "component").limit(limit).collect()
    asked = [(np.array([r["rep"] for r in rows]), np.array([r["component"] for r in rows]), unit_rows([r["vector"] for r in rows])) for rows in _by_length(drawn)]

    def run(batches):
        for b in batches:
            for rep, component, q in asked:
                rows = b.filter(pa.array(b.column("vector").value_lengths().to_numpy() == q.shape[1]))
                for at in range(0, len(rows), 4096):
                    part = rows.slice(at, 4096)
                    hit = _matrix(part.column("vector")) @ q.T >= threshold
                    hit &= part.column("rep").to_numpy()[:, None] != rep[None, :]
                    same = hit & (part.column("component").to_numpy()[:, None] == component[None, :])
                    yield pa.RecordBatch.from_arrays([pa.array([int(hit.sum())]), pa.array([int(same.sum())])], ["true", "found"])

    row = named.select("rep", "vector", "component").mapInArrow(run, "true long, found long").agg(F.sum("true").alias("true"), F.sum("found").alias("found")).first()
    return row["true"] or 0, row["found"] or 0


def _by_length(rows: list) -> list[list]:
    out: dict = {}
    for r in rows:
        out.setdefault(len(r["vector"]), []).append(r)
    return list(out.values())


def near_vectors(
    vectors: DataFrame,
    threshold: float = 0.95,
    shard_rows: int = 2048,
    margin: float = 0.05,
    overlap: int = 8,
    degree: int = 24,
    beam: int = 16,
    reach: float = 0.9,
    sample_rows: int = 20_000,
    audit_queries: int = 512,
    audit_links: int = 64,
    wanted_recall: float = 0.97,
    least_recall: float = 0.9,
    rounds: int = 4,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept, audited_recall): vectors linked at a cosine of ``threshold`` or more.

    ``vectors`` has vec_id and embedding. Equal vectors form a class; the graph
    has one node a class, and n_links counts the vectors of linked classes and
    the others of the own class.

    A round places every vector in the shards of its two nearest clusters and of
    others nearly as near (by ``margin``, ``overlap`` in all), builds a
    robust-pruned graph in each shard, unites the adjacency lists of all, and
    searches them in each shard from its medoids, spreading from what is near
    enough; then it goes on over the united lists to neighbours that share no
    shard (by nodes with a cosine of ``reach`` or more). The found groups are
    verified: every vector is compared in double precision with all others of
    its group (``count_links``), which gives n_links and lets no link within a
    group go uncounted.

    The recall is audited after every round on ``audit_queries`` vectors drawn
    by hash, compared with all, and comes back as a column; while they have
    fewer than ``audit_links`` links, four times as many are drawn, up to 16
    times the number or all vectors (null if even those have none). Below ``wanted_recall`` another round with other centres adds to what
    is found; a recall below ``least_recall`` after ``rounds`` is an error.

    Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing, and vectors of different lengths not with each other. A
    row without a vec_id links, counts and ties like any other; its component_id
    is the smallest id of its group, null if none has one. Rows that share a
    vec_id are vectors of their own, each with its own links. An empty table
    gives no rows; other columns are not read.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    valid = F.coalesce(F.forall("vector", finite) & F.exists("vector", lambda x: x != 0), F.lit(False))
    classes = rows.where(valid).groupBy("vector").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("rep"), "first", "vector", "n", F.size("vector").alias("dims")), "vectors")
    ties, recall = None, None
    for seed in range(1, rounds + 1):
        union, got = _graph_round(classes, threshold, shard_rows, margin, overlap, degree, beam, reach, sample_rows, seed)
        ties = got if ties is None else ties.union(got)
        component = materialize(connected_components(ties), "groups")
        more = materialize(across(union, classes, component, threshold), "across")
        if not more.isEmpty():
            ties = ties.union(more)
            component = materialize(connected_components(ties), "groups")
        named = classes.join(component, classes.rep == component.node, "left").select("rep", "first", "vector", "n", F.coalesce("component", "rep").alias("component"))
        named = materialize(named, "named")
        recall = audit(named, threshold, audit_queries, audit_links)
        logging.getLogger(__name__).info("round %d: audited recall %s", seed, recall)
        if recall is None or recall >= wanted_recall:
            break
    if recall is not None and recall < least_recall:
        raise RuntimeError(f"audited recall {recall:.3f} after {rounds} rounds")
    links = materialize(count_links(named, threshold), "links")
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    of_class = named.join(links, "rep", "left").join(least, "component")
    of_class = of_class.select(F.col("vector").alias("__vector"), F.xxhash64("vector").alias("__key"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    keyed = rows.withColumn("__key", F.when(valid, F.xxhash64("vector")))
    out = keyed.join(of_class, (keyed["__key"] == of_class["__key"]) & (F.col("vector") == F.col("__vector")), "left")
    component_id = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component_id.alias("component_id"), F.coalesce(F.col("vec_id") == component_id, F.lit(False)).alias("kept"), F.lit(recall).cast("double").alias("audited_recall"))
