import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spindrift.llm import phrases

from .conftest import DOCS, SCHEMA


def brute(rows, least=30, longest=4, top=2000, covered=80):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        small = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", small):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, count in f.items():
        some = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        inner = Counter()
        for p, a in some.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inner[p[i : i + m]] = max(inner[p[i : i + m]], a)
        found = []
        for p, a in some.items():
            if 100 * inner[p] < covered * a:
                score, _, le, ri = min((2000000 * a // (count[p[:k]] + count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), le, ri))
        out += [(lang, i + 1, p.decode(), -a, le, ri, n[lang], -s) for i, (s, a, p, le, ri) in enumerate(sorted(found)[:top])]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def chatter(seed, n):
    """Few words in skewed numbers, so that phrases of each length repeat, ties included."""
    rng = random.Random(seed)
    words = ["the", "The", "cat", "sat", "on", "mat", "é", "É", "x\x0by", "日本", "a.b", "tail,", "new", "york", "city", "b\x1cc", "w w"]
    stock = ["new york city hall", "on the mat", "New York", "the cat sat on"]
    return [(k, " ".join(rng.choice(stock) if rng.random() < 0.4 else rng.choice(words[: rng.randint(2, len(words))]) for _ in range(rng.randint(0, 30))), rng.choice(["en", "en", "de", "", None]), "s", 0) for k in range(n)]


@pytest.mark.parametrize("how", [{"least": 5}, {"least": 3, "top": 12}, {"least": 2, "longest": 6}, {"least": 4, "longest": 2}, {"least": 8, "covered": 50}])
def test_equals_counting_every_phrase(spark, how):
    rows = chatter(1, 300) + DOCS
    got = rows_of(phrases.collocations(spark.createDataFrame(rows, SCHEMA).repartition(5), **how))
    assert got == brute(rows, **how) and len(got) > 20


def test_a_full_set_only_counts_more(spark):
    """A few bits for hundreds of phrases: the set takes nearly all for frequent, the result is the same."""
    rows = chatter(2, 200)
    docs = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(phrases.collocations(docs, least=4, most_bits=64)) == brute(rows, least=4)


def test_set_has_all_its_hashes_and_few_others(spark):
    held = phrases.frequent_set(spark.range(6000).where("id % 2 = 0").select(F.xxhash64("id").alias("h")))
    every = spark.range(6000).select("id", F.xxhash64("id").alias("h")).collect()
    found = held.has(np.array([r.h for r in every], np.int64).view(np.uint64))
    assert all(found[r.id] for r in every if r.id % 2 == 0) and sum(found[r.id] for r in every if r.id % 2) < 150
    assert len(phrases.frequent_set(spark.range(99_999).select(F.xxhash64("id").alias("h")), most_bits=1 << 16).data) == 1 << 13


def test_pruned_phrases_are_not_counted(spark):
    """Pass 3 counts phrases of three words only where both pairs are frequent."""
    docs = spark.createDataFrame([(k, f"one two three{k % 50} four five", "en", "s", 0) for k in range(100)], SCHEMA)
    pairs = docs.select("lang", "text").repartition(1).mapInArrow(phrases._counted(phrases._pass(1, None, 4)), "lang string, phrase string, h long, n long")
    held = spark.sparkContext.broadcast(phrases.frequent_set(pairs.where("n >= 30")))
    second = docs.select("lang", "text").repartition(1).mapInArrow(phrases._counted(phrases._pass(2, held, 4)), "lang string, phrase string, h long, n long")
    assert second.agg(F.sum("n")).first()[0] == 200  # one two, four five
    held = spark.sparkContext.broadcast(phrases.frequent_set(second))
    third = docs.select("lang", "text").mapInArrow(phrases._counted(phrases._pass(3, held, 4)), "lang string, phrase string, h long, n long")
    assert {r.phrase for r in third.collect()} == {"one two", "four five"}


def test_shares_of_a_language(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(f"w{rng.randint(0, 25)}" for _ in range(60)), "en", "s", 0) for k in range(120)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(phrases.collocations(docs, least=4, top=5)) == brute(rows, least=4, top=5)  # several hundred phrases, shares of 80


def test_long_texts_and_words(spark):
    rows = [(1, "a b c, " * 60_000, "en", "s", 0), (2, "x" * 2_000_000, "en", "s", 0), (3, " \t\n" * 1000, "en", "s", 0), (4, "y" * 100_000 + " z. " + "y" * 100_000 + " z", "de", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(phrases.collocations(docs, least=2)) == brute(rows, least=2)


def test_empty_table_and_clashing_columns(spark, docs, no_docs):
    assert phrases.collocations(no_docs).collect() == []
    assert phrases.collocations(docs.where("text is null")).collect() == []
    for name in ("phrase", "n", "f", "words", "size", "salt", "share", "rank"):
        docs = docs.withColumn(name, F.lit("mine"))
    assert rows_of(phrases.collocations(docs, least=2)) == brute(DOCS, least=2)


def test_texts_are_read_once(spark):
    """All passes count from one reading of the texts, which are taken apart there."""
    rows = chatter(4, 120)
    read = spark.sparkContext.accumulator(0)

    def seen(row):
        read.add(1)
        return row

    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 3).map(seen), SCHEMA)
    assert rows_of(phrases.collocations(docs, least=4)) == brute(rows, least=4)
    assert read.value == len(rows)


@pytest.mark.parametrize("block_bytes", [1, 300, 1 << 20])
def test_stored_words_count_as_the_texts_do(spark, block_bytes):
    """Blocks of one text, of a few and of all, each of one language: read again they give what the texts gave."""
    rows = chatter(5, 60)
    texts = [pa.RecordBatch.from_arrays([pa.array([r[2] or "und" for r in part]), pa.array([r[1] for r in part])], ["lang", "text"]) for part in (rows[:25], rows[25:])]
    stored = list(phrases._counted(phrases._stored, block_bytes)(texts))
    assert len(stored) == 3 if block_bytes == 1 << 20 else 3 < len(stored) <= 60
    found = Counter()
    for b in phrases._again(phrases._pass(1, None, 4))(stored):
        for r in b.to_pylist():
            found[r["lang"], r["phrase"]] += r["n"]
    words = Counter((lang or "und", w.decode()) for _, text, lang, *_ in rows for w in phrases.words_of(text.encode()) if w != b".")
    assert found == words
