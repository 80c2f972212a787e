"""Katz backoff language model: counted, normalised and evaluated over blocks of tokens.

A block holds the tokens of some documents. For each order it asks the count
tables, which are cut into buckets by ranges of hashed n-grams, for the counts
of its distinct n-grams; the answers come back in the same order. Of the blocks
that have an n-gram, one owns it and adds its share to the sums of its history,
from which the backoff weights follow; these come back likewise. So what moves
is each block's distinct n-grams, sorted and packed, never its tokens, and a
task holds a block or a bucket, whatever the size of the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucketed, in_small_batches, materialize
from .simhash import word_pieces

#: No word has white space, so these can't be words.
END, BEGIN = (np.uint64(xxhash.xxh64_intdigest(b)) for b in (b"\n", b"\n\n"))
GOOD_TURING = 5
_MESSAGE = "n int, bucket int, block long, size long, a binary, b binary, c binary, d binary"
_FIELDS = [("n", pa.int32()), ("bucket", pa.int32()), ("block", pa.int64()), ("size", pa.int64()), *[(c, pa.binary()) for c in "abcd"]]
_NAMES = [name for name, _ in _FIELDS]


def _squeeze(x: np.ndarray) -> bytes:
    """Byte planes, compressed."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _expand(data: bytes, size: int, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    raw = pa.decompress(data, size * width, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, size).T).view(dtype).ravel()


def _squeeze_keys(keys: np.ndarray) -> bytes:
    return _squeeze(np.diff(keys, prepend=np.uint64(0)))


def _expand_keys(data: bytes, size: int) -> np.ndarray:
    return np.cumsum(_expand(data, size, np.uint64), dtype=np.uint64)


def _join(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    z = history * np.uint64(0x9E3779B97F4A7C15) + word
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


_BLOCK = "block long, docs long, tokens long, ids binary, known_ids binary, learn binary, lengths binary, n_words long, words binary, places binary"


def blocks_of(docs: DataFrame, block_tokens: int) -> DataFrame:
    """(block, …): tokens of about so many words of whole documents, as places in the block's own vocabulary.

    ``docs`` has doc_id, text and ``learn``, whether the model learns from it.
    """

    def run(batches):
        hashes, number = _Hashes(), 0
        held: list = [[], [], [], []]
        size = 0

        def block():
            nonlocal number, size
            ids, learn, lengths, parts = held
            tokens = np.concatenate(parts)
            words, place, count = np.unique(tokens, return_inverse=True, return_counts=True)
            order = np.argsort(-count, kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order))
            row = [(TaskContext.get().partitionId() << 32) + number, len(ids), len(tokens), _squeeze(np.array([i or 0 for i in ids], np.int64)), _squeeze(np.array([i is not None for i in ids], np.uint8)), _squeeze(np.array(learn, np.uint8)), _squeeze(np.array(lengths, np.int64)), len(words), _squeeze(words[order]), _squeeze(rank[place])]
            for x in held:
                x.clear()
            number, size = number + 1, 0
            return pa.RecordBatch.from_pylist([dict(zip([x.split()[0] for x in _BLOCK.split(", ")], row))])

        for b in batches:
            for i, text, learn in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                text, n = text.as_py(), 1
                for words in word_pieces(text.encode().lower()) if text else ():
                    held[3].append(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)))
                    n += len(words)
                held[3].append(np.array([END]))
                held[0].append(i)
                held[1].append(bool(learn))
                held[2].append(n)
                size += n
                if size >= block_tokens:
                    yield block()
                if len(hashes) > 500_000:
                    hashes.clear()
        if size:
            yield block()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "learn").mapInArrow(run, _BLOCK)


class Block:
    """A block's tokens, and for each order the keys of histories and n-grams at each place."""

    def __init__(self, row: dict, order: int):
        d = row["docs"]
        self.number = row["block"]
        self.ids, self.known_ids = _expand(row["ids"], d, np.int64), _expand(row["known_ids"], d, np.uint8).astype(bool)
        self.lengths = _expand(row["lengths"], d, np.int64)
        self.learn = _expand(row["learn"], d, np.uint8).astype(bool)
        words = _expand(row["words"], row["n_words"], np.uint64)
        token = words[_expand(row["places"], row["tokens"], np.uint32)]
        self.first = np.cumsum(self.lengths) - self.lengths
        self.history, self.gram = [np.zeros(0, np.uint64)], [token]
        for _ in range(2, order + 1):
            before = np.empty_like(token)
            before[1:] = self.gram[-1][:-1]
            before[self.first] = BEGIN
            self.history.append(before)
            self.gram.append(_join(before, token))


def _bucket_cuts(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each bucket's keys begin among sorted ones."""
    if not bits:
        return np.array([0, len(keys)])
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.r_[0, np.searchsorted(keys, edges), len(keys)]


def _messages(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(_NAMES, r)) for r in rows], pa.schema(_FIELDS))


def _spread(n: int, block: int, bits: int, keys: np.ndarray, *values: np.ndarray):
    """A message to each bucket that has keys."""
    cuts = _bucket_cuts(keys, bits)
    for bucket in np.flatnonzero(np.diff(cuts)):
        a, b = cuts[bucket], cuts[bucket + 1]
        data = [_squeeze_keys(keys[a:b]), *[_squeeze(v[a:b]) for v in values]]
        yield [n, int(bucket), block, int(b - a), *data, *[None] * (4 - len(data))]


def _requests(order: int, bits: int):
    """Each block's distinct n-grams of each order and how often its learned documents have them."""

    def run(batches):
        for row in (r for b in batches for r in b.to_pylist()):
            block = Block(row, order)
            learned = np.repeat(block.learn, block.lengths)
            for n in range(1, order + 1):
                keys, place = np.unique(block.gram[n - 1], return_inverse=True)
                yield _messages(list(_spread(n, block.number, bits, keys, np.bincount(place[learned], minlength=len(keys)).astype(np.uint32))))

    return run


def _count(table: pa.Table) -> pa.Table:
    """A bucket's counts over all blocks: a row of kind 0 with the table, 1 for each block's answer, 2 with counts of counts."""
    rows = sorted(table.to_pylist(), key=lambda r: r["block"])
    n, bucket = rows[0]["n"], rows[0]["bucket"]
    each = [_expand_keys(r["a"], r["size"]) for r in rows]
    keys, first, place = np.unique(np.concatenate(each), return_index=True, return_inverse=True)
    count = np.bincount(place, np.concatenate([_expand(r["b"], r["size"], np.uint32) for r in rows])).astype(np.int64)
    owner = np.zeros(len(place), bool)
    owner[first] = True
    seen = count > 0
    out = [[0, n, bucket, None, int(seen.sum()), _squeeze_keys(keys[seen]), _squeeze(count[seen].astype(np.uint32)), None, None]]
    at = 0
    for r, k in zip(rows, each):
        mine = slice(at, at + len(k))
        out.append([1, n, bucket, r["block"], len(k), _squeeze((count[place[mine]] * 2 + owner[mine]).astype(np.uint32)), None, None, None])
        at += len(k)
    stats = np.r_[np.bincount(np.minimum(count, GOOD_TURING + 2), minlength=GOOD_TURING + 3)[1 : GOOD_TURING + 2], count.sum(), seen.sum()].astype(np.int64)
    out.append([2, n, bucket, None, len(stats), stats.tobytes(), None, None, None])
    return pa.Table.from_pylist([dict(zip(["kind", *_NAMES], r)) for r in out], pa.schema([("kind", pa.int32()), *_FIELDS]))


def discounts(counts_of_counts: list[int], most: int = GOOD_TURING) -> np.ndarray:
    """Katz's Good-Turing factors d[r] of counts r = 0..``most``; larger counts have 1.

    From the numbers of n-grams with count 1..most+1. A factor that doesn't lie
    between 0 and 1 (few or odd data) becomes (r - 1/2) / r.
    """
    n = [0.0, *map(float, counts_of_counts)]
    out = np.ones(most + 1)
    rest = (most + 1) * n[most + 1] / n[1] if n[1] else 1.0
    for r in range(1, most + 1):
        ratio = (r + 1) * n[r + 1] / (r * n[r]) if n[r] else -1.0
        d = (ratio - rest) / (1 - rest) if rest < 1 else -1.0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


class Model:
    """Numbers that all tasks share: a few for each order."""

    def __init__(self, stats: dict, order: int):
        self.order = order
        self.tokens, self.vocabulary = (int(x) for x in stats[1][-2:])
        self.factor = {n: discounts([int(x) for x in stats[n][:-2]]) for n in range(1, order + 1)}
        small = np.arange(GOOD_TURING + 1)
        kept = self.tokens - float((stats[1][:GOOD_TURING] * (small * (1 - self.factor[1]))[1:]).sum())
        if not self.tokens:
            self.scale, self.unseen = 0.0, 1.0
        elif kept < self.tokens:
            self.scale, self.unseen = 1 / self.tokens, 1 - kept / self.tokens
        else:  # nothing was discounted: one token more, unseen
            self.scale, self.unseen = 1 / (self.tokens + 1), 1 / (self.tokens + 1)

    def discounted(self, n: int, count: np.ndarray) -> np.ndarray:
        return count * np.where(count <= GOOD_TURING, self.factor[n][np.minimum(count, GOOD_TURING)], 1.0)

    def words(self, count: np.ndarray) -> np.ndarray:
        """Probability of single words; all unseen ones are one word."""
        return np.where(count > 0, self.discounted(1, count) * self.scale, self.unseen)


def _answers(row: dict, n: int, dtype, column: str = "a") -> np.ndarray:
    mine = sorted((m for m in row["answers"] if m["n"] == n), key=lambda m: m["bucket"])
    return np.concatenate([_expand(m[column], m["size"], dtype) for m in mine]) if mine else np.zeros(0, dtype)


def _probabilities(model: Model, block: Block, row: dict, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The probability of each place's word by order ``most``, and the words' own counts: from single words upwards, each order where it knows the n-gram, elsewhere its history's weight times the order below."""
    p = single = None
    for n in range(1, most + 1):
        place = np.unique(block.gram[n - 1], return_inverse=True)[1]
        count = (_answers(row, n, np.uint32) >> 1)[place].astype(np.int64)
        if n == 1:
            p, single = model.words(count), count
            continue
        where = np.unique(block.history[n - 1], return_inverse=True)[1]
        scale, weight = _answers(row, -n, np.float64)[where], _answers(row, -n, np.float64, "b")[where]
        p = np.where(count > 0, model.discounted(n, count) * scale, weight * p)
    return p, single


def _history_sums(model: Model, n: int, bits: int):
    """For each history of a block, over the n-grams that it owns: counts, discounted counts, and probability by the order below."""

    def run(batches):
        for row in (r for b in batches for r in b.to_pylist()):
            block = Block(row, n)
            below, _ = _probabilities(model, block, row, n - 1)
            _, at = np.unique(block.gram[n - 1], return_index=True)
            answer = _answers(row, n, np.uint32)
            count = (answer >> 1).astype(np.int64)
            keys, where = np.unique(block.history[n - 1], return_inverse=True)
            mine = np.flatnonzero((answer & 1).astype(bool) & (count > 0))
            of = where[at[mine]]
            sums = [np.bincount(of, x, len(keys)) for x in (count[mine], model.discounted(n, count[mine]), below[at[mine]])]
            yield _messages(list(_spread(-n, block.number, bits, keys, *sums)))

    return run


def _weights(table: pa.Table) -> pa.Table:
    """A bucket of histories: kind 0 has their tables, 1 each block's answer: the factor of discounted counts, and the backoff weight."""
    rows = sorted(table.to_pylist(), key=lambda r: r["block"])
    n, bucket = rows[0]["n"], rows[0]["bucket"]
    each = [_expand_keys(r["a"], r["size"]) for r in rows]
    keys, place = np.unique(np.concatenate(each), return_inverse=True)
    count, kept, below = (np.bincount(place, np.concatenate([_expand(r[c], r["size"], np.float64) for r in rows])) for c in "bcd")
    known = count > 0
    some = np.maximum(count, 1)
    full = known & (kept >= count)  # nothing discounted: one n-gram more, unseen
    scale = np.where(known, 1 / np.where(full, some + 1, some), 0.0)
    left = np.where(known, np.where(full, 1 / (some + 1), 1 - kept / some), 1.0)
    weight = np.where(known, left / np.maximum(1 - below, 1e-15), 1.0)
    out = [[0, n, bucket, None, int(known.sum()), _squeeze_keys(keys[known]), _squeeze(scale[known]), _squeeze(weight[known]), None]]
    at = 0
    for r, k in zip(rows, each):
        mine = place[at : at + len(k)]
        out.append([1, n, bucket, r["block"], len(k), _squeeze(scale[mine]), _squeeze(weight[mine]), None, None])
        at += len(k)
    return pa.Table.from_pylist([dict(zip(["kind", *_NAMES], r)) for r in out], pa.schema([("kind", pa.int32()), *_FIELDS]))


def _scores(model: Model):
    def run(batches):
        for row in (r for b in batches for r in b.to_pylist()):
            block = Block(row, model.order)
            p, count = _probabilities(model, block, row, model.order)
            base = np.log10((count + 1) / (model.tokens + model.vocabulary + 1))
            by_doc = lambda x: np.add.reduceat(x, block.first)
            yield pa.RecordBatch.from_arrays(
                [pa.array(block.ids, mask=~block.known_ids), pa.array(~block.learn), pa.array(block.lengths), pa.array(by_doc((count > 0).astype(np.int64))), pa.array(np.full(len(block.ids), model.tokens)), pa.array(by_doc(base)), pa.array(by_doc(np.log10(p)))],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return run


def score_texts(docs: DataFrame, learn: Column, order: int = 2, block_tokens: int = 2_000_000, bucket_tokens: int = 2_000_000) -> DataFrame:
    """The log10 probability of each whole text by a Katz model of ``order``, learned from the rows where ``learn`` holds.

    Gives doc_id, held_out (not learned from), n_tokens, n_known, train_tokens,
    base_score (add-one single words) and score. Tokens are the words, small
    letters for A-Z, and an end after each text. Counts up to 5 get Good-Turing
    discounts; what they free goes to the unseen words of a history, in
    proportion to the order below, so that each history's probabilities sum to
    one exactly; unseen words are one word. A history where nothing is
    discounted counts one n-gram more, unseen. Null and empty texts have the end
    alone; repeated rows count and are scored as often as they come; null
    ``learn`` is false. Without any text learned from all probabilities are 1.
    An empty table gives no rows; columns but doc_id and text are not read. A
    text of any length is one document of one block, which grows with it.

    N-grams and words are known by 64-bit hashes: two of them that collide count
    as one, which among a billion distinct ones is to be expected in 3 % of corpora, for one pair.

    Count tables (kind 0, order n) and tables of histories (kind 0, order -n)
    are written, partitioned by kind and order, to the shared folder.
    """
    rows = docs.withColumn("learn", F.coalesce(learn, F.lit(False)))
    with in_small_batches(docs.sparkSession):
        blocks = bucketed(blocks_of(rows, block_tokens), "tokens", "block")
    total = blocks.agg(F.sum("tokens")).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(1, total) / bucket_tokens))))
    kinds = "kind int, " + _MESSAGE
    asked = blocks.mapInArrow(_requests(order, bits), _MESSAGE).groupBy("n", "bucket").applyInArrow(_count, kinds)
    counts = materialize(asked, "ngrams", "kind", "n")
    stats = {n: np.zeros(GOOD_TURING + 3, np.int64) for n in range(1, order + 1)}
    for r in counts.where("kind = 2").select("n", "a").mapInArrow(_totals, "n int, at int, total long").groupBy("n", "at").agg(F.sum("total").alias("total")).collect():
        stats[r["n"]][r["at"]] = r["total"]
    model = Model(stats, order)

    answers = counts.where("kind = 1").select(*_NAMES)
    for n in range(2, order + 1):
        sums = _with_answers(blocks, answers).mapInArrow(_history_sums(model, n, bits), _MESSAGE)
        histories = materialize(sums.groupBy("n", "bucket").applyInArrow(_weights, kinds), "histories", "kind", "n")
        answers = answers.union(histories.where("kind = 1").select(*_NAMES))
    return _with_answers(blocks, answers).mapInArrow(_scores(model), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _totals(batches):
    """The numbers of each bucket, one a row."""
    for b in batches:
        for n, a in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            numbers = np.frombuffer(a, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([n] * len(numbers), pa.int32()), pa.array(range(len(numbers)), pa.int32()), pa.array(numbers)], ["n", "at", "total"])


def _with_answers(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    mine = answers.groupBy("block").agg(F.collect_list(F.struct("n", "bucket", "size", "a", "b")).alias("answers"))
    return blocks.join(mine.hint("merge"), "block")
