import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest

from spindrift.llm import centroids


def brute(rows, k=16, rounds=3, dims=64):
    """Lloyd's rounds over all distances, in Python's integers."""
    kept = [(i, [math.floor(Fraction(x) * 64) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in first[:k]]
    for r in range(rounds + 1):
        near = [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres)) for _, v in kept]
        if r < rounds:
            for n in range(len(centres)):
                mine = [v for (_, v), (_, at) in zip(kept, near) if at == n]
                if mine:
                    centres[n] = [sum(x) // len(mine) for x in zip(*mine)]
    fits = lambda x: x if x < 1 << 63 else None
    out = []
    for (i, _), (d, n) in zip(kept, near):
        of = fits(sum(x for x, m in near if m == n)) if all(x < 1 << 63 for x, m in near if m == n) else None
        whole = fits(sum(x for x, _ in near)) if all(x < 1 << 63 for x, _ in near) else None
        out.append((i, n, fits(d), of, whole, hashlib.sha256(",".join(map(str, centres[n])).encode()).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows, kind="double", **how):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(3)
    got = centroids.cluster(df, **how).collect()
    return sorted((tuple(r)[:6] for r in got), key=repr), got


def sample(seed, n, dims=64):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(12, dims))
    return [(i, [float(np.float32(x)) for x in middle[i % 12] + rng.normal(size=dims) * 0.4]) for i in range(n)]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_equals_all_distances(spark, kind):
    rows = sample(3, 400)
    rows += rows[:7] + [(1000, rows[5][1]), (1001, [0.5] * 64), (1002, [-0.5] * 64), (None, rows[9][1])]
    got, raw = run(spark, rows, kind)
    assert got == brute(rows)
    assert sum(r.n_distances for r in raw) < 0.8 * 4 * 16 * len(raw)


def test_bounds_spare_most_distances(spark):
    rng = np.random.default_rng(8)
    middle = rng.normal(size=(32, 8)) * 10
    rows = [(i, [float(x) for x in middle[i % 32] + rng.normal(size=8) * 0.05]) for i in range(3000)]
    got, raw = run(spark, rows, k=32, rounds=6, dims=8)
    assert got == brute(rows, 32, 6, 8)
    assert sum(r.n_distances for r in raw) < 0.5 * 7 * 32 * len(raw)


def test_ties_and_equal_centroids(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-1, 2, 4)]) for i in range(300)]  # 81 points: many ties, equal centroids, empty clusters
    got, _ = run(spark, rows, k=40, dims=4)
    assert got == brute(rows, 40, 3, 4)


def test_odd_vectors(spark):
    rows = sample(4, 60) + [(100, None), (101, []), (102, [1.0] * 63), (103, [1.0] * 65), (104, [float("nan")] + [0.0] * 63), (105, [float("inf")] + [0.0] * 63), (106, [None] + [0.0] * 63), (107, [0.0] * 64)]
    got, _ = run(spark, rows)
    assert got == brute(rows) and len(got) == 61


@pytest.mark.parametrize("big", [1e7, 1e9, 1e30, 1e100])
def test_large_components_stay_exact(spark, big):
    rows = sample(5, 30, 4) + [(100, [big, -big, 0.1, 0.2]), (101, [big * 1.01, -big, 0.1, 0.3])]
    got, _ = run(spark, rows, k=5, dims=4)
    assert got == brute(rows, 5, 3, 4)


def test_few_rows_empty_table_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    rows = sample(6, 3)
    got, _ = run(spark, rows)
    assert got == brute(rows)
    assert run(spark, [])[0] == []
    assert run(spark, [(1, None)])[0] == []
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for name in ("cluster", "upper", "lower", "distance", "vec", "n_distances", "label"):
        df = df.withColumn(name, F.lit("mine"))
    assert sorted((tuple(r)[:6] for r in centroids.cluster(df).collect()), key=repr) == brute(rows)
