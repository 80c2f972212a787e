import hashlib
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from spindrift.llm import sketches

from .conftest import DOCS


def parts(text):
    return Counter(p for p in re.split(sketches.BREAK, text) if p)


def like(a, b):
    """Likeness of two texts."""
    if a == b:
        return 1.0
    a, b = parts(a), parts(b)
    return min((a & b).total() / (a | b).total() if a | b else 1.0, 1 - 1 / (a.total() + b.total() + 1))


def brute(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    out = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), round(like(t, edited), 9), round(like(t, after), 9)))
    return out


def got(df, **kw):
    rows = sketches.fingerprint_versions(df, **kw).collect()
    return rows, [(r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in rows]


def order(rows):
    return sorted(rows, key=str)


def test_likeness_equals_sets(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").where("doc_id % 3 <> 1")
    rows, mine = got(docs, bucket_rows=8)
    assert order(mine) == order(brute([(r.doc_id, r.text) for r in docs.collect()]))


def test_odd_rows(spark, docs, no_docs):
    rows, mine = got(docs.withColumn("bucket", F.lit("x")).withColumn("next_text", F.lit("y")))
    assert order(mine) == order(brute([(d[0], d[1]) for d in DOCS]))
    same = {r.fingerprint for r in rows if r.doc_id in (1, 10)}
    assert len(same) == 1 and len({r.fingerprint for r in rows}) > 5
    assert sketches.fingerprint_versions(no_docs).count() == 0
    one = spark.createDataFrame([(5, "alone. here\nand there")], "doc_id long, text string")
    assert got(one)[1] == brute([(5, "alone. here\nand there")])


def test_peeling_recovers_the_digests(spark):
    a, b = list(range(1, 41)), list(range(31, 61))
    rows = spark.createDataFrame([(0, 1, a, b)], "bucket long, row long, a array<long>, b array<long>")
    cells = sketches.sketch(sketches._exploded(rows, ("a", "b")), ("bucket", "row", "version"), "digests", 192)
    left = sketches.peel(sketches.subtract(cells, ("bucket", "row"), {0: (0, 1)}), ("bucket", "row", "pair"), 192, 12).collect()
    assert {(r.found, r.n) for r in left if r.cell == -1} == {(x, 1) for x in a if x not in b} | {(x, -1) for x in b if x not in a}
    assert all(r.cell == -1 for r in left)
    often = spark.createDataFrame([(0, 1, a * 7 + [-5] * 1000, b + a * 3 + [-5] * 2)], "bucket long, row long, a array<long>, b array<long>")
    cells = sketches.sketch(sketches._exploded(often, ("a", "b")), ("bucket", "row", "version"), "digests", 192)
    left = sketches.peel(sketches.subtract(cells, ("bucket", "row"), {0: (0, 1)}), ("bucket", "row", "pair"), 192, 12).collect()
    assert {(r.found, r.n) for r in left} == {(x, 4 - (x in b)) for x in a} | {(x, -1) for x in b if x not in a} | {(-5, 998)}
    small = sketches.sketch(sketches._exploded(rows, ("a", "b")), ("bucket", "row", "version"), "digests", 24)
    assert any(r.cell >= 0 for r in sketches.peel(sketches.subtract(small, ("bucket", "row"), {0: (0, 1)}), ("bucket", "row", "pair"), 24).collect())


def test_order_and_repeats_count(spark):
    texts = ["A b. C d.", "C d. A b.", "C d. A b. A b.", "", "\n", "A b. C d.", "x. " * 500, "x. " * 501, "x. y. " * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows, mine = got(docs)
    assert order(mine) == order(brute(list(enumerate(texts))))
    assert {r.doc_id: round(r.near_next, 6) for r in rows}[7] == round(500 / 501, 6)  # one paragraph more of 500
    prints = {r.doc_id: r.fingerprint for r in rows}
    assert prints[0] == prints[5] and len(set(prints.values())) == len(texts) - 1
    assert all((a == b) == (texts[i] == texts[j]) for i, a in prints.items() for j, b in prints.items())


def test_hot_ids_are_spread(spark):
    """A third without an id, a third with one id, and ids close together: no bucket grows with them, and the order is right."""
    rng = random.Random(4)
    rows = [(None, f"n{k}") for k in range(300)] + [(77, f"s{k}") for k in range(300)] + [(k, f"d{k}") for k in range(1000, 1300)] + [(10**15 + k, f"f{k}") for k in range(10)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    placed = sketches.in_order(docs, bucket_rows=10, segments=16).collect()
    assert len(placed) == len(rows) and max(Counter(r.bucket for r in placed).values()) <= 80
    hashed = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    line = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashed[r[1]]))
    after = {t: line[(k + 1) % len(line)][1] for k, (_, t) in enumerate(line)}
    assert {r.text: r.next_text for r in placed} == after
