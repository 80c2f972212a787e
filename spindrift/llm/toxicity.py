"""Toxicity: subword-bag embeddings averaged into a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PASSAGE = 8
#: Words of over ``LONGEST`` characters are read as pieces that begin ``STEP`` characters apart.
LONGEST, STEP = 64, 8
_MUL, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def pieces_of(marked: str, most: int = 6) -> list[str]:
    """Pieces of a long word, its ends marked: each n-gram of up to ``most`` characters lies whole in one of them."""
    return [marked[at : at + STEP + most - 1] for at in range(0, len(marked) - most + 1, STEP)]


def tokens_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of the texts, small letters, their ends marked; of each word its place there and its text. Null counts as empty.

    Words end at ASCII white space. A long word (a text in a script without
    blanks is one) counts as several words, its pieces.
    """
    lists = pc.ascii_split_whitespace(pc.utf8_lower(texts.cast(pa.large_string()).fill_null("")))
    flat, owner = lists.flatten(), np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())
    some = pc.not_equal(flat, "")
    coded = flat.filter(some).dictionary_encode()
    words, place, text = coded.dictionary, coded.indices.to_numpy().astype(np.int64), owner[some.to_numpy(zero_copy_only=False)]
    marked = pc.binary_join_element_wise(pa.scalar("<", pa.large_string()), words, pa.scalar(">", pa.large_string()), pa.scalar("", pa.large_string()))
    if (pc.utf8_length(words).to_numpy() <= LONGEST).all():
        return marked, place, text
    parts = [pieces_of(w) if len(w) > LONGEST + 2 else [w] for w in marked.to_pylist()]
    size = np.array([len(p) for p in parts])
    coded = pa.array([x for p in parts for x in p], pa.large_string()).dictionary_encode()
    n = size[place]
    at = np.repeat((np.cumsum(size) - size)[place] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64)[at], np.repeat(text, n)


def passages_of(text: np.ndarray) -> np.ndarray:
    """Where passages of so many words start, given each word's text."""
    first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]]) if len(text) else np.zeros(0, np.int64)
    size = np.diff(np.r_[first, len(text)])
    return np.flatnonzero((np.arange(len(text)) - np.repeat(first, size)) % PASSAGE == 0)


def highest(weight: np.ndarray, text: np.ndarray, texts: int, bias: float) -> np.ndarray:
    """Each text's highest logit over its runs of ``PASSAGE`` words, wherever they start, from the words' weights; without words the bias."""
    out = np.full(texts, bias)
    first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]]) if len(text) else np.zeros(0, np.int64)
    if len(first):
        size = np.diff(np.r_[first, len(text)])
        left = np.repeat(first + size, size) - np.arange(len(text))
        run = weight.astype(np.float64)
        for k in range(1, PASSAGE):  # sums of a text's own words alone, so equal texts have equal scores
            run[:-k] += np.where(left[:-k] > k, weight[k:], 0.0)
        run[(left < PASSAGE) & (np.repeat(size, size) >= PASSAGE)] = -np.inf
        out[text[first]] = np.maximum.reduceat(run, first) / PASSAGE + bias
    return out


def subwords(words: pa.Array, buckets: int, least: int = 3, most: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character n-grams of words from ``tokens_of`` and of the words themselves; with each its word, in order."""
    code = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.uint64)
    length = pc.utf8_length(words).to_numpy().astype(np.int64)
    first, word = np.cumsum(length) - length, np.repeat(np.arange(len(length)), length)
    at = np.arange(len(code)) - np.repeat(first, length)
    left = np.repeat(length, length) - at
    grams, owners = [], []
    power, run = np.cumprod(np.r_[np.uint64(1), np.full(LONGEST + 2, _MUL)]), code
    if len(words):
        grams.append(np.add.reduceat((code + np.uint64(1)) * power[at], first))
        owners.append(np.arange(len(words)))
    for n in range(2, most + 1):
        run = run[:-1] * _MUL + code[n - 1 :]
        if n >= least:
            fits = np.flatnonzero(left[: len(run)] >= n)
            grams.append(run[fits] + np.uint64(n))
            owners.append(word[fits])
    gram, owner = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (grams, owners))
    gram ^= gram >> np.uint64(29)
    gram = (gram * _MIX >> np.uint64(32)) % np.uint64(buckets)
    order = np.argsort(owner, kind="stable")
    return gram[order].astype(np.int64), owner[order].astype(np.int64)


@dataclass
class Model:
    """The trained model, with embeddings and softmax folded into a weight for each bucket: the logit of a passage is linear in both."""

    weight: np.ndarray
    bias: float
    scale: float = 1.0
    shift: float = 0.0

    def scorer(self):
        return _Scorer(self)


class _Scorer:
    """Scores of texts, a few megabytes at a time."""

    def __init__(self, model: Model, piece_bytes: int = 1 << 22):
        self.model, self.piece_bytes = model, piece_bytes

    def logits(self, texts: pa.Array) -> np.ndarray:
        """The highest logit of each text's passages; without words, that of the bare bias."""
        out = np.full(len(texts), self.model.bias)
        size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64))
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + self.piece_bytes, "right")))
            words, place, text = tokens_of(texts.slice(at, to - at))
            if len(place):
                gram, owner = subwords(words, len(self.model.weight))
                weight = np.bincount(owner, self.model.weight[gram], len(words)) / np.bincount(owner, minlength=len(words))
                out[at:to] = highest(weight[place], text, to - at, self.model.bias)
            at = to
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.model.scale * self.logits(texts) + self.model.shift, -30, 30)))

    def score(self, text: str | None) -> float:
        return float(self.scores(pa.array([text], pa.large_string()))[0])


def train(texts: list[str | None], toxic: list[int], buckets: int = 1 << 17, dims: int = 8, rounds: int = 3, epochs: int = 4, rate: float = 1.0, seed: int = 7) -> Model:
    """Embeddings and softmax trained jointly by gradient descent on passages.

    A toxic text's label holds for the text, not for each of its passages: the
    first round takes all of them, later rounds only those that the last model
    scores highest in their text. At the end the text's highest logit is
    calibrated to the labels. Without both classes, or any word, the model is the prior.
    """
    y = np.array(toxic, np.float64)
    if not len(y) or y.min() == y.max() or not any(t and t.split() for t in texts):
        prior = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.01
        return Model(np.zeros(buckets), 0.0, 0.0, float(np.log(prior / (1 - prior))))
    words, word, of = tokens_of(pa.array(texts, pa.large_string()))
    first = passages_of(of)
    text_of, count = of[first], np.diff(np.r_[first, len(word)])
    gram, gram_of = subwords(words, buckets)
    length = np.bincount(gram_of, minlength=len(words))
    n, rng = len(text_of), np.random.default_rng(seed)
    label = y[text_of]
    emb, soft, bias = rng.normal(0, 0.1, (buckets, dims)), np.array([[-1.0] * dims, [1.0] * dims]) / np.sqrt(dims), 0.0
    chosen, fold = np.arange(n), None
    for turn in range(rounds):
        pos, neg = chosen[label[chosen] == 1], chosen[label[chosen] == 0]
        size = 512
        for epoch in range(epochs if turn else 2):
            negative = rng.permutation(neg)[: max(4 * len(pos), 2000)] if turn else neg
            order = rng.permutation(np.concatenate([pos, negative]))
            weight_pos = max(1.0, min(20.0, len(negative) / max(1, len(pos))))
            for at in range(0, len(order), size):
                batch = order[at : at + size]
                at_word = np.repeat(first[batch] - np.r_[0, np.cumsum(count[batch])[:-1]], count[batch]) + np.arange(count[batch].sum())
                ids, inverse = np.unique(word[at_word], return_inverse=True)
                mine = np.repeat(np.arange(len(batch)), count[batch])
                at_gram = np.concatenate([np.arange(a, b) for a, b in zip(np.searchsorted(gram_of, ids), np.searchsorted(gram_of, ids, "right"))])
                gids, ginv = np.unique(gram[at_gram], return_inverse=True)
                gowner = np.repeat(np.arange(len(ids)), length[ids])
                # bag matrices are applied by sorted segment sums
                vec_word = np.add.reduceat(emb[gids][ginv], np.r_[0, np.cumsum(length[ids])[:-1]], axis=0) / length[ids][:, None]
                starts = np.r_[0, np.cumsum(count[batch])[:-1]]
                vec = np.add.reduceat(vec_word[inverse], starts, axis=0) / PASSAGE
                diff = soft[1] - soft[0]
                p = 1 / (1 + np.exp(-np.clip(vec @ diff + bias, -30, 30)))
                target = label[batch]
                g = (p - target) * np.where(target == 1, weight_pos, 1.0) / len(batch)
                grad_vec = g[:, None] * diff[None, :] / PASSAGE
                grad_soft = g @ vec
                grad_word = np.stack([np.bincount(inverse, grad_vec[mine, d], len(ids)) for d in range(dims)], 1) / length[ids][:, None]
                grad_emb = np.stack([np.bincount(ginv, grad_word[gowner, d], len(gids)) for d in range(dims)], 1)
                step = grad_emb / (np.sqrt((grad_emb**2).mean(1, keepdims=True)) + 1e-7)
                emb[gids] -= rate * 0.05 * step
                soft -= rate * 0.1 * np.stack([-grad_soft, grad_soft])
                bias -= rate * 0.1 * g.sum()
        fold = emb @ (soft[1] - soft[0])
        by_word = np.add.reduceat(fold[gram], np.r_[0, np.cumsum(length)[:-1]]) / length
        logit = np.add.reduceat(by_word[word], first) / PASSAGE + bias
        best = np.full(len(y), -np.inf)
        np.maximum.at(best, text_of, logit)
        chosen = np.flatnonzero((label == 0) | (logit >= best[text_of] - 1e-12))
    scale, shift = _calibrate(highest(by_word[word], of, len(y), bias), y)
    return Model(fold, bias, scale, shift)


def _calibrate(logit: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Logistic fit of the label to the logit by Newton steps, slightly regularised."""
    spread = logit.std() or 1.0
    x = np.stack([(logit - logit.mean()) / spread, np.ones_like(logit)], 1)
    w, target = np.zeros(2), y * 0.98 + 0.01
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-2, 1e-6])
        step = np.linalg.solve(h, x.T @ (p - target) + np.array([1e-2, 0.0]) * w)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / spread), float(w[1] - w[0] * logit.mean() / spread)


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column, per_class: int = 1500) -> Model:
    """A model from at most ``per_class`` labelled documents of each class, whole texts, the first in hash order.

    ``docs`` has doc_id and text, ``labels`` doc_id and toxic; a document with
    several labels counts as toxic if one is 1. Null labels and ids don't count.
    Of rows with one id the least text is taken, so the driver has a row for each
    drawn id. Without labels, or with those of one class, the model is the prior.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(may_learn)
    counts = known.agg(F.count_if(F.col("toxic") == 1).alias("t"), F.count_if(F.col("toxic") != 1).alias("c")).first()
    hashed = F.xxhash64("doc_id")
    ids = known.where("toxic = 1").orderBy(hashed, "doc_id").limit(per_class).union(known.where("toxic <> 1").orderBy(hashed, "doc_id").limit(per_class))
    drawn = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")  # at most 2 x per_class ids
    rows = drawn.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"] or ""))
    model = train([r["text"] for r in rows], [r["toxic"] for r in rows])
    taken = [min(per_class, counts[c]) for c in ("t", "c")]
    if all(taken):  # from the sample's odds to those of all labels
        model.shift += float(np.log(counts["t"] / counts["c"]) - np.log(taken[0] / taken[1]))
    return model


def score(model: Model):
    """A column function: text to its toxicity from 0 to 1; null and empty texts get the score of no words.

    Whole texts are read, words of any length included; equal texts have equal
    scores, in every row of theirs.
    """

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = model.scorer()
        for texts in batches:
            yield pa.array(scorer.scores(texts))

    return run
