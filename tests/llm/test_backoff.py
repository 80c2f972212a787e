import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from spindrift.llm import backoff
from spindrift.llm.common import doc_bucket

from .conftest import DOCS


def brute(docs, learn, order):
    """Katz by dictionaries: (n_tokens, n_known, N, base, score) of each row."""
    texts = [(t or "").encode().lower().split() + [None] for _, t in docs]
    counts = {n: Counter() for n in range(1, order + 1)}

    def history(words, k, n):
        h = tuple(words[max(0, k - n + 1) : k])
        return ("begin", *h) if len(h) < n - 1 else h

    for (i, _), words in zip(docs, texts):
        if learn(i):
            for k, w in enumerate(words):
                for n in counts:
                    counts[n][history(words, k, n), w] += 1
    factor = {}
    for n, c in counts.items():
        by = Counter(c.values())
        factor[n] = backoff.discounts([by[r] for r in range(1, 7)])
    kept = lambda n, r: r * (factor[n][r] if r <= 5 else 1)
    total, vocabulary = sum(counts[1].values()), len(counts[1])
    sum1 = sum(kept(1, r) for r in counts[1].values())
    if not total:
        norm, unseen = 1, 1.0
    elif sum1 < total:
        norm, unseen = total, 1 - sum1 / total
    else:
        norm, unseen = total + 1, 1 / (total + 1)
    follow = {n: defaultdict(list) for n in range(2, order + 1)}
    for n in follow:
        for (h, w), r in counts[n].items():
            follow[n][h].append((w, r))

    def p(n, words, k, w):
        if n == 1:
            r = counts[1][(), w]
            return kept(1, r) / norm if r else unseen
        h = history(words, k, n)
        seen = follow[n].get(h)
        if not seen:
            return p(n - 1, words, k, w)
        count, discounted = sum(r for _, r in seen), sum(kept(n, r) for _, r in seen)
        full = discounted >= count
        r = counts[n][h, w]
        if r:
            return kept(n, r) / (count + full)
        left = 1 / (count + 1) if full else 1 - discounted / count
        return left / (1 - sum(p(n - 1, words, k, y) for y, _ in seen)) * p(n - 1, words, k, w)

    out = []
    for words in texts:
        base = sum(math.log10((counts[1][(), w] + 1) / (total + vocabulary + 1)) for w in words)
        out.append((len(words), sum(counts[1][(), w] > 0 for w in words), total, base, sum(math.log10(p(order, words, k, w)) for k, w in enumerate(words))))
    for n in range(2, order + 1):  # exactly normalised over the known words and the unseen one
        for words in texts[:2]:
            k = len(words) - 1
            assert abs(sum(p(n, words, k, w) for _, w in counts[1]) + p(n, words, k, b"never seen") - 1) < 1e-9
    return out


def close(a, b):
    return len(a) == len(b) and all(x[:3] == y[:3] and abs(x[3] - y[3]) < 1e-6 and abs(x[4] - y[4]) < 1e-6 for x, y in zip(sorted(a), sorted(b)))


@pytest.mark.parametrize("order, block, bucket", [(2, 60, 40), (3, 10**6, 10**6)])
def test_scores_equal_brute_force(spark, small, order, block, bucket):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").where("doc_id < 40")
    got = backoff.score_texts(docs, doc_bucket(F.col("doc_id"), 7) != 2, order, block, bucket).collect()
    rows = [tuple(r) for r in docs.collect()]
    want = brute(rows, lambda i: zlib.crc32(str(i).encode()) % 7 != 2, order)
    assert close([(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got], want)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in got)


def test_odd_rows(spark, docs, no_docs):
    got = backoff.score_texts(docs.withColumn("learn", F.lit("x")), F.col("doc_id") != 12, 2).collect()
    want = brute([(d[0], d[1]) for d in DOCS if len(d[1] or "") < 10**5 or True], lambda i: i is not None and i != 12, 2)
    assert close([(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got], want)
    assert backoff.score_texts(no_docs, F.lit(True)).count() == 0
    none = backoff.score_texts(docs, F.lit(False)).collect()
    assert all(r.score == 0 and r.base_score == 0 and r.held_out for r in none)


def test_discounts_fall_back():
    assert list(backoff.discounts([0] * 6)) == [1, 0.5, 0.75, 2.5 / 3, 3.5 / 4, 4.5 / 5]
    d = backoff.discounts([1000, 400, 220, 140, 100, 70])
    assert all(0 < x < 1 for x in d[1:])
