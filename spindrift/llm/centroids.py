"""Centroid clustering: Lloyd's rounds in exact integers, with Yinyang bounds that spare most distances.

The centroids are put into groups once. Each vector keeps an upper bound of the
distance to its centroid and, for each group, a lower bound of the distance to
the group's other centroids. When centroids have moved, the bounds move as far;
a vector all of whose lower bounds lie above its upper bound stays where it is,
and else only the centroids of groups whose bound lies below are measured.
Bounds are floating, with slack for their rounding; what decides is always a
squared distance in exact integers.

A round is one pass over the written vectors without a shuffle; sums of clusters
are made in tasks and added by Spark, so the driver sees a number for each
component of each centroid, whatever the rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_small_batches, materialize

_LONG = 1 << 63
_LIMB = 40


def _largest(x: np.ndarray) -> int:
    return int(abs(x).max()) if x.size else 0


def to_integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of finite doubles; Python's integers where they pass 2^53, ``scale`` being a power of two."""
    scaled = np.floor(x * scale)
    if np.abs(scaled).max(initial=0) < 1 << 53:
        return scaled.astype(np.int64)
    return np.array([[int(v) * scale if abs(v) >= 1 << 53 else math.floor(v * scale) for v in row] for row in x.tolist()], object)


def _exact_type(dims: int, largest: int):
    """The fastest numbers in which squared distances of such components are exact."""
    bound = 4 * max(1, dims) * largest * largest
    return np.float64 if bound < 1 << 53 else np.int64 if bound < _LONG else object


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of each row of ``x`` to each of ``c``, exact."""
    kind = _exact_type(x.shape[1], max(_largest(x), _largest(c)))
    x, c = x.astype(kind), c.astype(kind)
    d = (x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * (x @ c.T)
    return d if kind is object else d.astype(np.int64)


def squared_pairs(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of each row of ``x`` to the same row of ``c``, exact."""
    kind = _exact_type(x.shape[1], max(_largest(x), _largest(c)))
    apart = x.astype(kind) - c.astype(kind)
    d = (apart * apart).sum(1)
    return d if kind is object else d.astype(np.int64)


def _root(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64))


def group_centroids(centres: np.ndarray, groups: int, rounds: int = 5) -> list[np.ndarray]:
    """The numbers of the centroids in each group, ascending: near ones together."""
    x = centres.astype(np.float64)
    middle = x[np.arange(groups) * len(x) // groups]
    for _ in range(rounds):
        of = ((x[:, None] - middle[None]) ** 2).sum(-1).argmin(1)
        for g in range(groups):
            if (of == g).any():
                middle[g] = x[of == g].mean(0)
    return [np.flatnonzero(of == g) for g in range(groups) if (of == g).any()]


class Round:
    """Centroids, their groups, and how far each came since the round before."""

    def __init__(self, centres: np.ndarray, groups: list[np.ndarray], drift: np.ndarray):
        self.centres, self.groups, self.drift = centres, groups, drift
        self.moved = np.array([drift[g].max() for g in groups])

    def assign(self, x: np.ndarray, at: np.ndarray, upper: np.ndarray, lower: np.ndarray, measure_all: bool):
        """(cluster, upper, lower, squared distance or -1, number of distances measured) of each vector."""
        at, upper, lower = at.copy(), upper + self.drift[at], lower - self.moved
        distance, n = np.full(len(at), -1, object), np.zeros(len(at), np.int64)
        slack = 1e-9 * (1 + upper + self.moved.max(initial=0))
        rows = np.flatnonzero(measure_all | (lower.min(1) <= upper + slack))
        if not len(rows):
            return at, upper, lower, distance, n
        y, old, slack, low = x[rows], at[rows], slack[rows], lower[rows]
        own = squared_pairs(y, self.centres[old])
        best, best_d, measured = old.copy(), own.copy(), np.ones(len(rows), np.int64)
        slack = np.where(np.isfinite(slack), slack, 1e-9 * (1 + _root(own)))
        scans = []
        for g, members in enumerate(self.groups):
            near = np.flatnonzero(low[:, g] <= _root(best_d) + slack)
            if len(near):
                d = squared(y[near], self.centres[members])
                measured[near] += len(members)
                first = d.argmin(1)  # the smallest number among equal ones
                c, c_d = members[first], d[np.arange(len(near)), first]
                better = ((c_d < best_d[near]) | ((c_d == best_d[near]) & (c < best[near]))).astype(bool)
                best[near[better]], best_d[near[better]] = c[better], c_d[better]
                scans.append((g, members, near, d))
        for g, members, near, d in scans:
            others = _root(d)
            others[members[None] == best[near][:, None]] = np.inf
            low[near, g] = others.min(1)
        for g, members in enumerate(self.groups):
            left = np.isin(old, members) & (best != old)  # the centroid that it left counts for its group from now on
            low[left, g] = np.minimum(low[left, g], _root(own[left]))
        at[rows], upper[rows], lower[rows], distance[rows], n[rows] = best, _root(best_d), low, best_d, measured
        return at, upper, lower, distance, n


_STATE = [("cluster", pa.int32()), ("upper", pa.float64()), ("lower", pa.list_(pa.float64())), ("distance", pa.int64()), ("n_distances", pa.int64())]


def _vectors(column: pa.ListArray, scale: int) -> np.ndarray:
    return to_integers(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1), scale)


def _assign(shared: Round, scale: int, first: bool, last: bool):
    def run(batches):
        for b in batches:
            x, n = _vectors(b.column("vec"), scale), len(b)
            if first:
                at, upper, lower, seen = np.zeros(n, np.int64), np.full(n, np.inf), np.zeros((n, len(shared.groups))), 0
            else:
                at, upper = b.column("cluster").to_numpy().astype(np.int64), b.column("upper").to_numpy()
                lower, seen = b.column("lower").flatten().to_numpy().reshape(n, -1), b.column("n_distances").to_numpy()
            at, upper, lower, distance, measured = shared.assign(x, at, upper, lower, last)
            bounds = pa.FixedSizeListArray.from_arrays(pa.array(lower.ravel()), lower.shape[1]).cast(_STATE[2][1])
            fits = [int(d) if 0 <= d < _LONG else None for d in distance]
            arrays = [pa.array(at, pa.int32()), pa.array(upper), bounds, pa.array(fits, pa.int64()), pa.array(measured + seen)]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("vec"), *arrays], ["vec_id", "vec", *[name for name, _ in _STATE]])

    return run


def _sums(k: int, scale: int):
    """(cluster, part, limb, value): a task's counts (part -1) and sums of components, cut into limbs so that sums of any size add exactly."""

    def run(batches):
        counts, total = np.zeros(k, np.int64), None
        for b in batches:
            x, at = _vectors(b.column("vec"), scale), b.column("cluster").to_numpy()
            counts += np.bincount(at, minlength=k)
            total = np.zeros((k, x.shape[1]), object) if total is None else total
            for c in np.unique(at):
                mine = x[at == c]
                total[c] += mine.astype(object).sum(0) if len(mine) * _largest(mine) >= _LONG else mine.sum(0)
        rows: list[tuple] = [(c, -1, 0, int(counts[c])) for c in np.flatnonzero(counts)]
        for c in np.flatnonzero(counts):
            for part, value in enumerate(total[c]):
                value, sign, limb = abs(int(value)), 1 if value >= 0 else -1, 0
                while value:
                    rows.append((c, part, limb, sign * (value & ((1 << _LIMB) - 1))))
                    value, limb = value >> _LIMB, limb + 1
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], ["cluster", "part", "limb", "value"])

    return run


def _moved(state: DataFrame, centres: np.ndarray, scale: int) -> np.ndarray:
    """Each centroid at the floor of its vectors' mean; one without vectors stays."""
    parts = state.select("vec", "cluster").mapInArrow(_sums(len(centres), scale), "cluster int, part int, limb int, value long")
    sums = np.zeros((len(centres), centres.shape[1] + 1), object)
    for r in parts.groupBy("cluster", "part", "limb").agg(F.sum("value").alias("value")).collect():
        sums[r["cluster"], r["part"]] += r["value"] << (_LIMB * r["limb"])
    out = centres.astype(object)
    for c in np.flatnonzero(sums[:, -1]):
        out[c] = [v // sums[c, -1] for v in sums[c, :-1]]
    return out.astype(np.int64) if _largest(out) < 1 << 53 else out


def kept_vectors(vectors: DataFrame, dims: int) -> DataFrame:
    """(vec_id, vec): the rows whose vector has exactly ``dims`` components, all of them finite."""
    single = isinstance(vectors.schema["embedding"].dataType, T.ArrayType) and isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType)
    vec = F.col("embedding") if single else F.col("embedding").cast("array<double>")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec")).where((F.size("vec") == dims) & finite)


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1, groups: int | None = None) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, n_distances): ``k`` clusters after ``rounds`` updates.

    Components become floor(``scale`` * x). Centroids start as the vectors with
    the smallest sha256 of "seed:vec_id", of equal ones (repeated ids) the
    smallest vectors; a null id counts as an empty one. ``distance`` is squared;
    ties go to the smaller number; ``n_distances`` says how many distances were
    measured for the vector over all rounds. Rows whose vector is null, of other
    length, or holds null or non-finite components have no row; repeated rows
    count and come back as often as they come; where fewer than ``k`` vectors
    are left, all are centroids; an empty table gives no rows. Columns but vec_id
    and embedding are not read. A distance or inertia beyond a long is null, and
    components of over 1e150, whose squares no double holds, are an error.

    What goes to all tasks are the centroids: ``k`` times ``dims`` numbers.
    """
    spark = vectors.sparkSession
    kept = kept_vectors(vectors, dims)
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    start = kept.orderBy(key, "vec").limit(k).collect()
    if not start:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, n_distances long")
    centres = to_integers(np.array([r["vec"] for r in start], np.float64), scale)
    by_group = group_centroids(centres, groups or -(-len(centres) // 4))
    drift = np.zeros(len(centres))
    schema = T.StructType([*kept.schema.fields, T.StructField("cluster", T.IntegerType()), T.StructField("upper", T.DoubleType()), T.StructField("lower", T.ArrayType(T.DoubleType())), T.StructField("distance", T.LongType()), T.StructField("n_distances", T.LongType())])
    state = kept
    with in_small_batches(spark, 2000):
        for r in range(rounds + 1):
            step = _assign(Round(centres, by_group, drift), scale, r == 0, r == rounds)
            state = materialize(state.mapInArrow(step, schema), "assigned")
            if r < rounds:
                moved = _moved(state, centres, scale)
                drift = _root(squared_pairs(moved, centres)) * (1 + 1e-12)
                centres = moved
    sums = state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d"), F.max(F.col("distance").isNull()).alias("beyond")).collect()
    within = {r["cluster"]: None if r["beyond"] else int(r["d"]) for r in sums}
    all_of = None if None in within.values() else sum(within.values())
    as_long = lambda v: v if v is not None and v < _LONG else None
    text = [hashlib.sha256(",".join(str(int(v)) for v in c).encode()).hexdigest() for c in centres]
    rows = [(c, as_long(d), as_long(all_of), text[c]) for c, d in within.items()]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = state.join(F.broadcast(facts), "cluster")
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "n_distances")


def cluster_sql(k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1) -> str:
    """The same in SQL: every vector against every centroid in each round."""
    ctes = [
        f"parts AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})",
        f"v AS (SELECT vec_id, i, floor({scale} * x)::BIGINT AS x FROM parts)",
        f"start AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS c FROM (SELECT DISTINCT vec_id FROM v) ORDER BY 2 LIMIT {k})",
        "c0 AS (SELECT c, i, x FROM start JOIN v USING (vec_id))",
    ]
    for r in range(rounds + 1):
        near = f"SELECT v.vec_id, c.c, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS d FROM v JOIN c{r} c USING (i) GROUP BY v.vec_id, c.c"
        ctes.append(f"a{r} AS (SELECT vec_id, c, d FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, c) AS place FROM ({near})) WHERE place = 1)")
        if r < rounds:
            ctes.append(f"s{r} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM v JOIN a{r} USING (vec_id) GROUP BY c, i)")
            floor = "(s - ((s % n) + n) % n) // n"
            ctes.append(f"c{r + 1} AS (SELECT o.c, o.i, coalesce({floor}, o.x)::BIGINT AS x FROM c{r} o LEFT JOIN s{r} USING (c, i))")
    sha = f"t AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY c)"
    return f"WITH {', '.join([*ctes, sha])} SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, h AS centroid_sha256 FROM a{rounds} JOIN t USING (c)"
