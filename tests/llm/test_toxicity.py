import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from spindrift.llm import toxicity

STEMS = ["grumpf", "snarlet", "wretchi"]


def corpus(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeioulnstr") for _ in range(rng.randint(2, 8)))
    rows = []
    for k in range(n):
        words, toxic = [word() for _ in range(rng.randint(5, 300))], int(k % 4 == 0)
        if toxic:
            at = rng.randint(0, len(words))
            words[at:at] = [rng.choice(STEMS) + rng.choice(["", "en", "ol", "ast", "ir", "x", "esk"]) for _ in range(4)]
        rows.append((k, " ".join(words), toxic))
    return rows


def test_unseen_spellings_are_caught():
    rows = corpus(1, 400)
    model = toxicity.train([r[1] for r in rows], [r[2] for r in rows])
    scorer, held = model.scorer(), corpus(2, 200)
    said = [scorer.score(t) >= 0.5 for _, t, _ in held]
    assert sum(a for a, r in zip(said, held) if r[2]) >= 45 and sum(a for a, r in zip(said, held) if not r[2]) <= 3
    assert scorer.score("some plain text with grumpfonk grumpfalo snarletip wretchion in it") > 0.5
    assert scorer.score("") < 0.5 and scorer.score(None) == scorer.score(" ")


def test_fit_and_score(spark, docs, no_docs):
    rows = corpus(3, 240)
    df = spark.createDataFrame([(r[0], r[1], r[2]) for r in rows], "doc_id long, text string, score long")
    labels = spark.createDataFrame([(r[0], 1, r[2]) for r in rows] + [(0, 0, 0), (None, 0, 1), (999, 0, None), (998, 1, 1)], "doc_id long, quality long, toxic long")
    model = toxicity.fit(df, labels, F.col("doc_id") % 5 != 0, per_class=60)
    got = {r.doc_id: r.s for r in df.select("doc_id", toxicity.score(model)("text").alias("s")).collect()}
    held = [r for r in rows if r[0] % 5 == 0]
    assert sum((got[i] >= 0.5) == bool(t) for i, _, t in held) >= len(held) - 2
    odd = docs.select("doc_id", toxicity.score(model)("text").alias("s")).collect()
    assert len(odd) == docs.count() and all(0 <= r.s <= 1 for r in odd)
    assert no_docs.select(toxicity.score(model)("text")).count() == 0


def test_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality long, toxic long")
    assert toxicity.fit(docs, none, F.lit(True)).scorer().score("anything") < 0.5
    alike = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality long, toxic long")
    assert toxicity.fit(docs, alike, F.lit(True)).scorer().score("anything") < 0.5


def test_long_words_are_read_to_their_end():
    rows = corpus(1, 400)
    model = toxicity.train([r[1] for r in rows], [r[2] for r in rows])
    scorer, plain = model.scorer(), [r[1] for r in corpus(2, 200) if not r[2] and len(r[1]) > 300][:10]
    for between in ("", "\u00a0", "_", "、"):
        for text in plain:
            clean = between.join(text.split())
            for at in (0, 70, 150, len(clean)):
                assert scorer.score(clean[:at] + between + between.join(["grumpfonk", "snarletip", "wretchion", "grumpfalo"]) + between + clean[at:]) > 0.5 > scorer.score(clean)
    words, place, text = toxicity.tokens_of(pa.array(["ab " + "語" * 70 + "x", None, "c" * 64, "d" * 65]))
    assert sorted(set(text)) == [0, 2, 3] and words[place[0]].as_py() == "<ab>" and "<" + "c" * 64 + ">" in words.to_pylist()
    for length in range(65, 90):
        word = "".join(map(chr, range(0x4E00, 0x4E00 + length)))
        pieces = toxicity.tokens_of(pa.array([word]))[0].to_pylist()
        assert all(any(f"<{word}>"[k : k + 6] in p for p in pieces) for k in range(length - 3))


def plain_score(model, text):
    """A text's score word by word and run by run, in plain Python."""
    mask, mul, mix = (1 << 64) - 1, int(toxicity._MUL), int(toxicity._MIX)

    def bucket(x):
        x = (x ^ (x >> 29)) & mask
        return ((x * mix & mask) >> 32) % len(model.weight)

    def weight(marked):
        code = [ord(c) for c in marked]
        found = [bucket(sum((c + 1) * pow(mul, i, 1 << 64) for i, c in enumerate(code)) & mask)]
        for n in range(3, 7):
            for at in range(len(code) - n + 1):
                run = code[at]
                for c in code[at + 1 : at + n]:
                    run = (run * mul + c) & mask
                found.append(bucket((run + n) & mask))
        return sum(model.weight[b] for b in found) / len(found)

    words = []
    for w in (text or "").lower().split(" "):
        if w:
            words += toxicity.pieces_of(f"<{w}>") if len(w) > toxicity.LONGEST else [f"<{w}>"]
    each = [weight(w) for w in words]
    size = toxicity.PASSAGE
    runs = [each[k : k + size] for k in range(max(1, len(each) - size + 1))] if each else []
    logit = max(sum(r) for r in runs) / size + model.bias if runs else model.bias
    return 1 / (1 + np.exp(-np.clip(model.scale * logit + model.shift, -30, 30)))


def test_scores_equal_plain_python(spark):
    rows = corpus(5, 80)
    df = spark.createDataFrame([(r[0], r[1]) for r in rows] + [(500, "x" * 200), (501, None), (502, "Über " * 9), (503, rows[0][1]), (0, rows[0][1])], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic long")
    model = toxicity.fit(df.withColumn("toxic", F.lit("clash")), labels, F.col("doc_id") % 5 != 0)
    got = df.select("doc_id", "text", toxicity.score(model)("text").alias("s")).collect()
    assert len(got) == 85 and all(abs(r.s - plain_score(model, r.text)) < 1e-9 for r in got)
    assert len({r.s for r in got if r.doc_id in (0, 503)}) == 1


def test_an_id_of_many_rows_is_one_row_to_learn_from(spark):
    rows = corpus(6, 60)
    once = spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic long")
    many = once.union(once.where("doc_id < 3")).union(once.where("doc_id = 1").withColumn("text", F.lit("~ later in order")))
    a, b = (toxicity.fit(d, labels, F.lit(True)) for d in (once, many))
    assert (a.weight == b.weight).all() and (a.scale, a.shift) == (b.scale, b.shift)
