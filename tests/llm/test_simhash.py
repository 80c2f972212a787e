import random
import re
import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from spindrift.llm import simhash
from spindrift.llm.common import materialize
from spindrift.llm.components import connected_components
from spindrift.llm.vectors import merge

from .conftest import DOCS


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def components(ids, prints, most=3):
    label = list(range(len(ids)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for a in range(len(ids)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= most:
                label[root(a)] = root(b)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return [least.get(root(k)) for k in range(len(ids))]


def test_groups_equal_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).withColumn("hex", simhash.hex_fingerprint(F.col("fp"))).collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    prints = [fingerprint(t) for _, t in rows]
    for (i, _), p, c in zip(rows, prints, components([r[0] for r in rows], prints)):
        assert (got[i].hex, got[i].component_id) == (f"{p:016x}", c)
    assert len({r.component_id for r in got.values()}) < len(rows)


def test_odd_rows(docs, no_docs):
    got = sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs.withColumn("fp", F.lit("x"))).collect()), key=str)
    prints = [fingerprint(d[1]) for d in DOCS]
    assert got == sorted(zip([d[0] for d in DOCS], prints, components([d[0] for d in DOCS], prints)), key=str)
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.keep_one(no_docs).count() == 0
    odd = docs.withColumn("fp", F.lit("x")).withColumn("group", F.lit(None)).withColumn("blocks", F.lit(3))
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 11, 12, 3, 6, 7, 8, 9, None]


def test_a_null_id_ties_what_is_near(spark):
    a, b, c = 0, 0b111, 0b111111
    df = spark.createDataFrame([(4, "x"), (None, "y"), (9, "z")], "doc_id long, text string")
    prints = {"x": a, "y": b, "z": c}
    names = F.create_map(*[F.lit(v) for kv in prints.items() for v in kv])
    fake = lambda docs, width: docs.select("doc_id", names[F.col("text")].cast("long").alias("fp"))
    was, simhash.fingerprints = simhash.fingerprints, fake
    try:
        got = sorted(((r.doc_id, r.fp, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    finally:
        simhash.fingerprints = was
    assert got == [(4, a, 4), (9, c, 4), (None, b, 4)]


def shingles(text, width=5):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    return {" ".join(words[k : k + width]) for k in range(len(words) - width + 1)} or ({" ".join(words)} if words else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def similar_groups(rows, similarity=0.8):
    """Each row's group, from the similarity of all pairs."""
    sets, label = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if jaccard(sets[a], sets[b]) >= similarity:
                label[root(a)] = root(b)
    return [root(k) for k in range(len(rows))]


def edited(rng, words, share):
    """The words with about so many of them changed, close together."""
    n = max(1, int(len(words) * share))
    at = rng.randrange(len(words) - n + 1)
    return words[:at] + [f"new{rng.random()}" for _ in range(n)] + words[at + n :]


def test_one_of_similar_texts_stays(spark, small):
    rng = random.Random(3)
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    base = [t.split() for _, t in rows if t and len(t.split()) > 80][:60]
    for k in range(300):
        rows.append((100_000 + k, " ".join(edited(rng, rng.choice(base), rng.choice([0.02, 0.05, 0.08, 0.2])))))
    crowd = [f"w{k}" for k in range(120)]
    rows += [(200_000 + k, " ".join(edited(rng, crowd, 0.05))) for k in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    near = {r.doc_id: r.group for r in simhash.similar_texts(df).collect()}
    want = similar_groups(rows)
    ours = [near[i] for i, _ in rows]
    split = sum(len({ours[k] for k in range(len(rows)) if want[k] == g}) - 1 for g in set(want))
    assert split <= 0.04 * sum(want[k] != k for k in range(len(rows)))
    for g in set(ours):  # no false tie
        assert len({want[k] for k in range(len(rows)) if ours[k] == g}) == 1
    first = {}
    for (i, _), g in zip(rows, ours):
        first[g] = min(first.get(g, i), i)
    assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == sorted(first.values())


def test_tree_ties_what_the_bucket_ties():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, (6, 4), dtype=np.uint64)
    fps = np.concatenate([b[None] ^ (np.uint64(1) << rng.integers(0, 64, (20, 4), dtype=np.uint64)) for b in base])
    reps = rng.permutation(len(fps))
    for limit in (3, 8):
        u, v = simhash.bucket_tree(fps, reps, limit)
        hit = np.bitwise_count(fps[:, None] ^ fps[None]).sum(-1) <= limit
        place = np.argsort(reps)
        assert hit[place[u], place[v]].all()
        want, got = np.arange(len(fps)), np.arange(len(fps))
        merge(want, *(reps[x] for x in np.nonzero(hit)))
        merge(got, u, v)
        assert (want == got).all()


def test_long_texts_in_pieces(monkeypatch):
    text = "  ".join(f"Word{k} ÀB\tx" for k in range(400)).encode()
    whole = simhash.fingerprint_of(text)
    monkeypatch.setattr(simhash, "_PIECE", 64)
    assert simhash.fingerprint_of(text) == whole == fingerprint(text.decode())


@pytest.mark.parametrize("bucket_rows,extra", [(4096, 2), (5, 2), (4096, 3), (64, 4)])
def test_dense_buckets_lose_no_link(spark, bucket_rows, extra):
    rng = random.Random(bucket_rows)
    prints = []
    for _ in range(6):
        now = rng.getrandbits(64)
        for _ in range(40):
            prints.append(now)
            for _ in range(rng.choice([1, 2, 3, 4])):
                now ^= 1 << rng.randrange(64)
    prints = list(dict.fromkeys(prints))
    df = spark.createDataFrame([(k, p - (1 << 64) if p >> 63 else p) for k, p in enumerate(prints)], "rep long, fp long")
    got = {r.node: r.component for r in connected_components(simhash.near_links(df, extra=extra, bucket_rows=bucket_rows)).collect()}
    assert [got.get(k, k) for k in range(len(prints))] == components(list(range(len(prints))), prints)


def test_masks_grow_with_the_rows():
    assert [simhash.runs_beside(n) for n in (10, 1 << 30, 1 << 31, 1 << 37)] == [2, 2, 3, 4]
    assert [min(m.bit_count() for m in simhash._blocks(3, e)) for e in (2, 3, 4)] == [25, 31, 36]


def test_components_of_a_chain_and_nothing(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 60)] + [(100, 100), (None, 5), (200, 201), (201, 200)], "u long, v long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {k: 0 for k in range(61)} | {200: 200, 201: 200}
    assert connected_components(edges.where("u < -1")).count() == 0


def test_crowds_around_the_limit(spark):
    """Groups of texts that differ in about as much as may be: all that is near is verified, not the pairs of a tree alone."""
    rng = random.Random(5)
    rows = []
    for g in range(40):
        base = [f"w{rng.randrange(5000)}" for _ in range(300)]
        for k in range(12):
            words = list(base)
            for at in rng.sample(range(300), rng.randint(2, 7)):
                words[at] = f"x{rng.randrange(10**9)}"
            rows.append((12 * g + k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.group for r in simhash.similar_texts(docs).collect()}
    sets = [set(simhash.shingle_set(t, 5).tolist()) for _, t in rows]
    near = [(a, b) for g in range(40) for a in range(12 * g, 12 * g + 12) for b in range(a + 1, 12 * g + 12) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(near) > 300 and sum(got[a] != got[b] for a, b in near) <= 0.01 * len(near)
    assert len({got[k] for k in range(len(rows))}) > 60  # most groups fall apart


def test_written_tables_leave_no_shuffle(spark):
    """What a table shuffled goes when it is written, so many rounds need no more disk than one."""
    kept = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").count("shuffle_")
    was = kept()
    for _ in range(3):
        assert materialize(spark.range(0, 1000, 1, 4).groupBy((F.col("id") % 7).alias("k")).count(), "counts").count() == 7
    until = time.time() + 20
    while kept() > was + 6 and time.time() < until:  # those of the last count() stay; they go in the background
        time.sleep(0.5)
    assert kept() <= was + 6


def test_pairs_between_groups():
    import numpy as np

    fps = np.array([[0], [1], [3], [7], [1 << 60]], np.uint64)
    reps, groups = np.array([10, 11, 12, 13, 14]), np.array([1, 1, 1, 2, 3])
    pairs = lambda tried, limit, most: sorted(zip(*(x.tolist() for x in simhash.crossing_pairs(fps, reps, groups, tried, limit, most))))
    none = [None] * 5
    assert pairs(none, 1, 8) == [(13, 12), (14, 10)]
    assert pairs(none, 2, 8) == [(13, 11), (13, 12), (14, 10), (14, 11)]
    assert pairs(none, 2, 1) == [(13, 12), (14, 10)]
    assert pairs([None, None, None, [12], [10]], 2, 1) == [(13, 11), (14, 11)]
    assert pairs(none, 64, 0) == [] and simhash.crossing_pairs(fps, reps, np.ones(5), none, 64, 8)[0].tolist() == []
