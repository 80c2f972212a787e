import numpy as np
import pytest

from spindrift.llm import vectors


def brute(rows, threshold=0.95):
    """Links and components from the full matrix."""
    good = [k for k, (i, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, parent = [0] * len(rows), {k: k for k in range(len(rows))}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for n, a in enumerate(good):
        for b in good[n + 1 :]:
            x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
            if len(x) == len(y):
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                    links[a] += 1
                    links[b] += 1
                    parent[root(a)] = root(b)
    least = {}
    for k in good:
        least[root(k)] = min((x for x in (least.get(root(k)), rows[k][0]) if x is not None), default=None)
    return [(i, links[k], least[root(k)] if k in good else i) for k, (i, _) in enumerate(rows)]


def sample(seed, n, copies, dims=16):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dims))
    near = base[rng.integers(0, n, copies)] + rng.normal(size=(copies, dims)) * 0.05
    crowd = base[:1] + rng.normal(size=(60, dims)) * 0.02
    all_rows = np.concatenate([base, near, crowd, base[:5], 3 * base[:3]])
    return [(int(i), [float(x) for x in v]) for i, v in zip(rng.permutation(len(all_rows)), all_rows)]


@pytest.mark.parametrize("shard_rows", [1500, 64, 20])
def test_links_equal_brute_force(spark, shard_rows):
    rows = sample(5, 150, 60)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in vectors.near_vectors(df, shard_rows=shard_rows).collect()}
    want = brute(rows)
    assert all(got[i].n_links <= n for i, n, _ in want)
    found, true = sum(r.n_links for r in got.values()), sum(n for _, n, _ in want)
    assert found >= 0.97 * true > 0
    if found == true:
        assert [(i, got[i].component_id) for i, _, c in want] == [(i, c) for i, _, c in want]
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert got[0].audited_recall >= 0.97


def test_planted_links_over_several_hundred_shards(spark):
    rng = np.random.default_rng(11)
    base = rng.normal(size=(5000, 48))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    noise = rng.normal(size=(700, 48))
    near = base[:700] + 0.25 * noise / np.linalg.norm(noise, axis=1, keepdims=True)  # cosines about 0.97
    chain = [base[4000]]
    for _ in range(30):
        step = rng.normal(size=48)
        chain.append(chain[-1] / np.linalg.norm(chain[-1]) + 0.25 * step / np.linalg.norm(step))
    crowd = base[4500] + 0.03 * rng.normal(size=(300, 48))
    x = np.concatenate([base, near, chain[1:], crowd])
    ids = rng.permutation(len(x))
    df = spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(df, shard_rows=48, sample_rows=2000).collect()}
    unit = vectors.unit_rows(x.tolist())
    hit = unit @ unit.T >= 0.95
    np.fill_diagonal(hit, False)
    assert sum(n for n, _ in got.values()) >= 0.97 * hit.sum()
    assert all(got[int(ids[k])][0] <= hit[k].sum() for k in range(len(x)))
    label = np.arange(len(x))
    vectors.merge(label, *np.nonzero(hit))
    least = np.full(len(x), len(x))
    np.minimum.at(least, label, ids)
    assert np.mean([got[int(ids[k])][1] == least[label[k]] for k in range(len(x))]) >= 0.99


def test_equal_directions_cannot_be_split(spark):
    """All in one direction but for the length and a trace: a cluster that no centres split."""
    rng = np.random.default_rng(2)
    x = np.ones((120, 6)) * rng.uniform(1, 2, (120, 1)) + rng.normal(size=(120, 6)) * 1e-9
    df = spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = vectors.near_vectors(df, shard_rows=16).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(119, 0)}


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (9, [1e300, 1e290]), (10, [1.0, 0.0, 0.0]), (11, [-1.0, 0.0]), (None, [1.0, 0.0]), (12, [2.0, 0.0])]
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], "vec_id long, embedding array<double>, n_links string, cluster long")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(df).collect()}
    assert len(got) == len(rows)
    assert got == {i: (n, c) for i, n, c in brute(rows)}
    empty = df.where("vec_id < 0")
    assert vectors.near_vectors(empty).count() == 0


def test_repeated_ids(spark):
    rows = [(5, [1.0, 0.0]), (5, [1.0, 0.0]), (5, [0.0, 1.0]), (3, [0.0, 2.0]), (7, [1.0, 0.01])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in vectors.near_vectors(df).collect())
    assert got == [(3, 1, 3), (5, 1, 3), (5, 2, 5), (5, 2, 5), (7, 2, 5)]


def test_across_shards(spark):
    """1 and 3 are linked, but each shard saw only one of them, with 2 between."""
    angle = lambda a: [float(np.cos(np.radians(a))), float(np.sin(np.radians(a)))]
    classes = spark.createDataFrame([(1, angle(0)), (2, angle(20)), (3, angle(10)), (4, angle(90))], "rep long, vector array<double>")
    union = spark.createDataFrame([(2, [1, 3]), (4, []), (1, [2])], "src long, close array<long>")
    component = spark.createDataFrame([(2, 2)], "node long, component long")
    got = {(r.u, r.v) for r in vectors.across(union, classes, component, 0.95).collect()}
    assert got == {(1, 3), (2, 3)}


@pytest.mark.parametrize("rows", [40, 1000])
def test_counts_of_large_groups(spark, rows):
    """A tight crowd with outer vectors and a chain: core pairs are counted by number, all others compared."""
    rng = np.random.default_rng(9)
    middle = rng.normal(size=12)
    middle /= np.linalg.norm(middle)
    crowd = middle + 0.05 * rng.normal(size=(150, 12))
    outer = middle + 0.11 * rng.normal(size=(60, 12))
    other = rng.normal(size=(1, 12)) + 0.02 * rng.normal(size=(50, 12))
    x = vectors.unit_rows(np.concatenate([crowd, outer, other]).tolist())
    component = np.r_[np.zeros(210, int), np.full(50, 210)]
    n = rng.integers(1, 4, len(x))
    df = spark.createDataFrame([(k, [float(c) for c in v], int(m), int(g)) for k, (v, m, g) in enumerate(zip(x, n, component))], "rep long, vector array<double>, n long, component long")
    hit = (x @ x.T >= 0.95) & (component[:, None] == component[None, :])
    np.fill_diagonal(hit, False)
    got = {r.rep: r.links for r in vectors.count_links(df, 0.95, rows).collect()}
    assert got == dict(enumerate((hit @ n).tolist())) and 0 < hit[:210, :210].mean() < 0.95


def test_graph_finds_what_is_near():
    rng = np.random.default_rng(0)
    x = vectors.unit_rows(rng.normal(size=(600, 12)).tolist())
    x = np.concatenate([x, vectors.unit_rows((x[:200] + rng.normal(size=(200, 12)) * 0.05).tolist())])
    graph = vectors.build_graph(x, 16)
    assert (graph < len(x)).all() and len(graph) == 800
    label = vectors.range_groups(x, graph, vectors.medoids(x, 8), 16, 0.95)
    want = np.arange(800)
    hit = x @ x.T >= 0.95
    vectors.merge(want, *np.nonzero(hit))
    assert (label == want).mean() >= 0.99
