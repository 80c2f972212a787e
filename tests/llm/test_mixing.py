from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from spindrift.llm import mixing


def brute(unit, blocks):
    """Earliest deadline first, slot by slot."""
    period, done, out = sum(unit.values()), Counter(), []
    names = sorted(unit, key=str)
    for t in range(blocks):
        ready = [s for s in names if mixing.release(done[s], unit[s], period) <= t]
        s = min(ready, key=lambda s: (mixing.deadline(done[s], unit[s], period), names.index(s)))
        out.append(s)
        done[s] += 1
    return out


@pytest.mark.parametrize("unit", [{"a": 5, "b": 3, "c": 2}, {"a": 1}, {"a": 97, "b": 1, "c": 1, "d": 1}, {k: 1 for k in "abcdefg"}, {"a": 50, None: 25, "b": 25}])
def test_schedule_never_strays_by_a_block(unit):
    period, names, out = sum(unit.values()), sorted(unit, key=str), []
    done = mixing.Line([unit[s] for s in names]).advance([0] * len(unit), 0, period, out)
    assert done == [unit[s] for s in names]
    assert [names[k] for k in out] == brute(unit, period)
    seen = Counter()
    for t, k in enumerate(out, 1):
        seen[names[k]] += 1
        assert all(abs(seen[s] - t * u / period) < 1 for s, u in unit.items())


def test_units_keep_small_weights():
    assert mixing.units({"a": 1, "b": 1, "c": 1}, 100) in ({"a": 34, "b": 33, "c": 33},)
    assert mixing.units({"a": 1e9, "b": 1}, 10) == {"a": 9, "b": 1}
    with pytest.raises(ValueError):
        mixing.units({k: 1 for k in range(20)}, 10)


@pytest.mark.parametrize("max_slots", [1000, 12])
def test_mix_reaches_weights_and_loses_no_row(spark, max_slots):
    rows = [(i, "big" if i % 3 else "small", "x") for i in range(300)] + [(1000 + i, None, "y") for i in range(7)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, slot string")
    got = mixing.mix(docs, {"big": 3, "small": 2, None: 1, "absent": 5}, block_rows=4, resolution=60, bucket_rows=16, max_slots=max_slots).collect()
    assert {r.doc_id for r in got} == {r[0] for r in rows}
    assert sorted(r.position for r in got) == list(range(len(got)))
    by_slot = {r.slot: r.source for r in got}
    for t in range(1, len(by_slot) + 1):
        seen = Counter(by_slot[k] for k in range(t))
        assert all(abs(seen[s] - t * w / 6) < 1 for s, w in {"big": 3, "small": 2, None: 1}.items())
    assert all(r.release <= r.slot < r.deadline for r in got)
    copies = Counter((r.doc_id, r.epoch) for r in got)
    assert set(copies.values()) == {1}
    for s in ("big", "small", None):
        n = sum(r[1] == s for r in rows)
        each = Counter(r.doc_id for r in got if r.source == s)
        assert max(each.values()) - min(each.values()) <= 1 and len(each) == n


def test_mix_of_odd_tables(docs, no_docs):
    assert mixing.mix(no_docs).count() == 0
    got = mixing.mix(docs, block_rows=2, resolution=50)
    n = {r.source: r["count"] for r in docs.groupBy("source").count().collect()}
    assert {r.source for r in got.collect()} == set(n)
    first = got.where("epoch = 0")
    assert first.count() == docs.count()
    assert mixing.mix(docs, {"a": 0}).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs, max_sources=2)
    with pytest.raises(ValueError, match="max_epochs"):
        mixing.mix(docs, {"a": 1, "b": 10_000}, block_rows=2)
    assert got.agg(F.countDistinct("position")).first()[0] == got.count()


def test_default_weights_hold_at_any_length(spark):
    """Weights that are no whole units of a small resolution: less than a block off after every prefix."""
    counts = {"a": 20_011, "b": 7_003, "c": 1_013, "d": 97}
    docs = spark.createDataFrame([(k, s) for s, n in counts.items() for k in range(n)], "doc_id long, source string")
    got = sorted((r.slot, r.source) for r in mixing.mix(docs).where("position % 16 = 0").select("slot", "source").collect())
    weights = mixing.temperature_weights(counts)
    total, seen = sum(weights.values()), Counter()
    assert [t for t, _ in got] == list(range(len(got)))
    for t, s in got:
        seen[s] += 1
        assert all(abs(seen[k] - (t + 1) * w / total) < 1.001 for k, w in weights.items())


def test_the_whole_mix_equals_plain_python(spark):
    """Row by row: order by hash, blocks, and slots one after the other."""
    rows = [(k, "abc"[k % 7 % 3]) for k in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    weights = {"a": 5, "b": 2, "c": 1}
    got = sorted((r.position, r.doc_id, r.epoch) for r in mixing.mix(docs, weights, block_rows=4, resolution=8, bucket_rows=8).collect())
    hashed = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64(F.lit("mix"), "doc_id").alias("h")).collect()}
    count = Counter(s for _, s in rows)
    buckets = {s: -(-n // 8) for s, n in count.items()}
    stream = {s: sorted((k for k, x in rows if x == s), key=lambda k: (hashed[k] % buckets[s], hashed[k], k)) for s in count}
    done, want = Counter(), []
    line = brute({"a": 5, "b": 2, "c": 1}, 400)
    while any(done[s] * 4 < count[s] for s in count):
        s = line[len(want) // 4]
        for row in range(done[s] * 4, done[s] * 4 + 4):
            want.append((len(want), stream[s][row % count[s]], row // count[s]))
        done[s] += 1
    assert got == want


@pytest.mark.parametrize("warm_up", [0, 100])
def test_stretches_make_one_line(spark, warm_up):
    """Weights that divide nothing, dealt a few slots at a time: the slots of a single run, and the same with any start."""
    unit = mixing.units({"a": 0.61803, "b": 0.2, "c": 0.11, "d": 0.07, "e": 0.0017}, 1 << 40)
    names = sorted(unit)
    needed = [300, 90, 20, 30, 1]
    table, length, blocks = mixing.timetable(spark, [unit[s] for s in names], needed, stretch=37, warm_up=warm_up, piece=16)
    got = {}
    for r in table.collect():
        for i, slot in enumerate(r.slots):
            got[slot] = (names[r.source], r.piece * 16 + i)
    line, count = brute(unit, length), Counter()
    for t, s in enumerate(line):
        assert got.pop(t) == (s, count[s])
        count[s] += 1
    assert not got and [count[s] for s in names] == blocks
    assert all(count[s] >= n for s, n in zip(names, needed)) and any(count[s] == n and line[-1] == s for s, n in zip(names, needed))


@pytest.mark.parametrize("weights", [{"a": 10**9, "b": 3 * 10**8, "c": 10**7}, {k: 10**7 * (1 + k * k) ** 0.7 for k in range(20)}])
def test_no_source_strays_at_any_length(weights):
    """Far out on the line, against the weights themselves."""
    unit = mixing.units(weights, 1 << 60)
    names, total = sorted(unit, key=str), sum(Fraction(w) for w in weights.values())
    line = mixing.Line([unit[s] for s in names])
    for t in (10**8, 10**10 + 7):
        out = []
        done = line.likely(t)
        line.advance(done, t, t + 3000, out)
        for at, k in enumerate(out, t + 1):
            done[k] += 1
            if at % 50 == 0:
                assert all(abs(n - at * Fraction(weights[s]) / total) < 1 for n, s in zip(done, names))
