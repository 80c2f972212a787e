"""Phrase collocations by level-wise passes: longer phrases are counted only where both shorter ones in them are frequent.

The texts are read once and taken apart: of every 8 MB of a language, a row has
the words and the text as their numbers. The passes read these rows. The first
counts words. Pass k counts the phrases of k words whose first and last k-1 words
are frequent, which a set given to all tasks tells: bits at two hashes of each
frequent phrase, at most 2^28 of them (32 MB) however many phrases there are.
These candidates, most of which come but a few times, are counted by 64-bit
hashes; the same pass spells out the phrases of k-1 words that were frequent, and
counts them by their words. So hashes and bits say only what is looked at: a
phrase that comes often enough always passes them, one that doesn't is dropped by
its exact count. Tasks count a row at once before Spark adds up, so a frequent
phrase is no hot key. Each pass writes a table, and cuts are scored by joining
these.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import scratch
from .common import in_small_batches, materialize

#: What ends a piece, and the letters made small.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
_BREAK = b"."
_TABLE = bytes.maketrans(PIECE_ENDS, _BREAK * len(PIECE_ENDS))
_GOLD, _MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_CHUNK_BITS = 1 << 16
MOST_BITS = 1 << 28


def _mixed(a: np.ndarray, b) -> np.ndarray:
    z = a * _GOLD + b
    z = (z ^ (z >> np.uint64(30))) * _MIX1
    z = (z ^ (z >> np.uint64(27))) * _MIX2
    return z ^ (z >> np.uint64(31))


def _hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def words_of(text: bytes) -> list[bytes]:
    """The words of a text, small letters for A-Z, and a break (a lone full stop, which no word can be) where a piece ends."""
    return text.lower().translate(_TABLE).replace(_BREAK, b" . ").split()


class FrequentSet:
    """Bits at two places of each frequent hash."""

    def __init__(self, bits: int, chunks: dict[int, bytes]):
        self.mask = np.uint64(bits - 1)
        self.data = np.zeros(max(bits, _CHUNK_BITS) // 8, np.uint8)
        for number, data in chunks.items():
            self.data[number * _CHUNK_BITS // 8 :][: _CHUNK_BITS // 8] = np.frombuffer(data, np.uint8)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for at in _places(hashes, self.mask):
            found &= (self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found


def _places(hashes: np.ndarray, mask) -> tuple[np.ndarray, np.ndarray]:
    return hashes & mask, (hashes >> np.uint64(32)) & mask


def _start(lang: str) -> np.uint64:
    return np.uint64(_hash(lang.encode()))


def _chunk_rows(bits: int):
    """Hashes to (chunk, place): which bits they set, by chunks of 2^16."""

    def run(batches):
        for b in batches:
            hashes = b.column(0).to_numpy().view(np.uint64)
            at = np.unique(np.concatenate(_places(hashes, np.uint64(bits - 1)))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at // _CHUNK_BITS, pa.int32()), pa.array(at % _CHUNK_BITS, pa.int32())], ["chunk", "place"])

    return run


def _chunk(table: pa.Table) -> pa.Table:
    flags = np.zeros(_CHUNK_BITS, np.uint8)
    flags[table.column("place").to_numpy()] = 1
    return pa.table({"chunk": pa.array([table.column("chunk")[0].as_py()], pa.int32()), "data": pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())})


def frequent_set(frequent: DataFrame, most_bits: int = MOST_BITS) -> FrequentSet:
    """The set of the hashes ``h``: sixteen bits each or ``most_bits`` in all, made in tasks."""
    bits = min(1 << 16, most_bits)
    while bits < min(most_bits, 16 * frequent.count()):
        bits *= 2
    places = frequent.select("h").mapInArrow(_chunk_rows(bits), "chunk int, place int").distinct()
    chunks = places.groupBy("chunk").applyInArrow(_chunk, "chunk int, data binary").collect()  # at most `most_bits`
    return FrequentSet(bits, {r["chunk"]: bytes(r["data"]) for r in chunks})


_COUNTED = [("lang", pa.string()), ("phrase", pa.string()), ("h", pa.int64()), ("n", pa.int64())]
_STORED = "lang string, words string, ids binary"
#: Some blocks of texts in a row group, however many a task writes.
_ROW_GROUPS = {"parquet.block.size": str(16 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}


def _counted_rows(lang, phrases, hashes, counts) -> pa.RecordBatch:
    n = len(counts)
    none = lambda kind: pa.nulls(n, kind)
    arrays = [
        none(pa.string()) if phrases is None else pa.repeat(pa.scalar(lang, pa.string()), n),
        none(pa.string()) if phrases is None else phrases,
        none(pa.int64()) if hashes is None else pa.array(hashes.view(np.int64)),
        pa.array(counts, pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(arrays, [name for name, _ in _COUNTED])


class _Words:
    """Some texts of a language as numbers of words, 0 for a break, and the hashes of the phrases from each place on."""

    def __init__(self, lang: str, names: list[bytes], ids: np.ndarray):
        self.lang, self.names, self.ids = lang, names, ids

    @cached_property
    def hashes(self) -> np.ndarray:
        return np.fromiter(map(_hash, self.names), np.uint64, len(self.names))

    @classmethod
    def of_texts(cls, lang: str, texts: list[bytes]) -> _Words:
        found = pa.array([_BREAK, *words_of(b"\n".join(texts))], pa.large_binary()).dictionary_encode()
        return cls(lang, found.dictionary.to_pylist(), found.indices.to_numpy()[1:])

    @classmethod
    def of_row(cls, lang: str, names: bytes, ids: bytes) -> _Words:
        return cls(lang, names.split(b" "), np.frombuffer(ids, np.int32))

    def row(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([self.lang], pa.string()), pa.array([b" ".join(self.names)], pa.binary()).cast(pa.string()), pa.array([self.ids.astype(np.int32).tobytes()], pa.binary())], ["lang", "words", "ids"])

    def words(self) -> pa.RecordBatch:
        count = np.bincount(self.ids, minlength=len(self.names))[1:]
        return _counted_rows(self.lang, pa.array(self.names[1:], pa.binary()).cast(pa.string()), _mixed(_start(self.lang), self.hashes[1:]), count)

    def phrases(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, hashes) of all phrases of ``k`` words without a break."""
        n = len(self.ids) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        whole = np.ones(n, bool)
        for j in range(k):
            whole &= self.ids[j : n + j] != 0
        at = np.flatnonzero(whole)
        h = np.full(len(at), _start(self.lang))
        for j in range(k):
            h = self.longer(h, at + j)
        return at, h

    def longer(self, h: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Hashes of phrases with hashes ``h`` and one word more, those at some places."""
        return _mixed(h, self.hashes[self.ids[at]])

    def spelled(self, at: np.ndarray, k: int) -> pa.RecordBatch:
        """The phrases of ``k`` words at some places, counted by their words."""
        key, largest = self.ids[at].astype(np.int64), len(self.names) - 1
        for j in range(1, k):  # exact: numbers of words, or of what was seen so far, one behind the other
            if (largest + 1) * len(self.names) >= 1 << 63:
                key = np.unique(key, return_inverse=True)[1]
                largest = int(key.max(initial=0))
            key = key * len(self.names) + self.ids[at + j]
            largest = (largest + 1) * len(self.names) - 1
        _, first, count = np.unique(key, return_index=True, return_counts=True)
        names = pa.array(self.names, pa.large_binary()).cast(pa.large_string())
        words = [names.take(pa.array(self.ids[at[first] + j])) for j in range(k)]
        return _counted_rows(self.lang, pc.binary_join_element_wise(*words, pa.scalar(" ", pa.large_string())).cast(pa.string()), None, count)


def _pass(k: int, shared, longest: int):
    """What pass ``k`` makes of some words: the phrases of k-1 words in the shared set, spelled out, and hashes of those of k words both of whose overlapping parts are in it."""

    def rows(words: _Words):
        if k == 1:
            yield words.words()
            return
        at, h = words.phrases(k - 1)
        frequent = shared.value.has(h)
        at, h = at[frequent], h[frequent]
        if k > 2:
            yield words.spelled(at, k - 1)
        if k <= longest:
            begins = np.zeros(len(words.ids) + 1, bool)
            begins[at] = True
            both = begins[at + 1]
            found, count = np.unique(words.longer(h[both], at[both] + k - 1), return_counts=True)
            yield _counted_rows(words.lang, None, found, count)

    return rows


def _counted(rows, block_bytes: int = 8 << 20):
    """``rows`` of the words of each language's texts, about ``block_bytes`` together; at most four times that wait."""

    def run(batches):
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        size = 0
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary())):
                text = text.as_py()
                held.setdefault(lang, []).append(text)
                sizes[lang] = sizes.get(lang, 0) + len(text)
                size += len(text)
                full = [lang] if sizes[lang] >= block_bytes else list(held) if size >= 4 * block_bytes else []
                for one in full:
                    size -= sizes.pop(one)
                    yield from rows(_Words.of_texts(one, held.pop(one)))
        for one in list(held):
            yield from rows(_Words.of_texts(one, held.pop(one)))

    return run


def _stored(words: _Words):
    yield words.row()


def _again(rows):
    """``rows`` of stored words."""

    def run(batches):
        for b in batches:
            for lang, names, ids in zip(*b.columns):
                yield from rows(_Words.of_row(lang.as_py(), names.as_buffer().to_pybytes(), ids.as_buffer()))

    return run


def phrase_levels(docs: DataFrame, least: int = 30, longest: int = 4, most_bits: int = MOST_BITS) -> tuple[list[DataFrame], DataFrame]:
    """([(lang, phrase, f) of 1, 2, … words], (lang, n)): all phrases that come ``least`` times or more, and how many words each language has."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    enough = F.col("f") >= least

    with in_small_batches(spark):
        stored = scratch.written(texts.mapInArrow(_counted(_stored), _STORED), "numbered", options=_ROW_GROUPS)

    def counted(k: int, shared, keep: Column, name: str) -> DataFrame:
        rows = stored.mapInArrow(_again(_pass(k, shared, longest)), "lang string, phrase string, h long, n long")
        return scratch.written(rows.groupBy("lang", "phrase", "h").agg(F.sum("n").alias("f")).where(keep), name, batch_rows=1)  # a row is a block of texts

    words = counted(1, None, F.lit(True), "words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    last = words.where(enough)
    levels = [last.select("lang", "phrase", "f")]
    for k in range(2, longest + 2):
        shared = spark.sparkContext.broadcast(frequent_set(last, most_bits))
        found = counted(k, shared, enough, f"pass-{k}")
        shared.unpersist()
        if k > 2:
            levels.append(found.where("phrase is not null").select("lang", "phrase", "f"))
        last = found.where("phrase is null")
    return levels, totals


def _parts(words: Column, first, n) -> Column:
    return F.array_join(F.slice(words, first, n), " ")


def _of_parts(cuts: DataFrame, column: str, levels: DataFrame, count: str) -> DataFrame:
    """``cuts`` with the count of the phrase in ``column``. A word that comes f times begins or ends f / ``least`` phrases of each length at most, so no key has as many rows as the word has places."""
    return cuts.join(levels.select("lang", F.col("phrase").alias(column), F.col("f").alias(count)), ["lang", column])


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, top: int = 2000, covered: int = 80, most_bits: int = MOST_BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to ``longest`` words by their lowest-scoring cut.

    ``a`` is how often the phrase comes, in pieces of text between ends of
    sentences, clauses and lines, overlaps included; a cut's score is
    floor(2000000 * a / (l + r)), its parts coming ``l`` and ``r`` times. Ties
    between cuts go to the shorter first part. A phrase is left out if its words
    lie in a longer one, of at most ``longest`` words, that comes in ``covered``
    percent of its places or more. ``n`` counts all words of the language. Null
    ``lang`` is `und`, null text is empty; repeated rows count as often as they
    come; texts are read whole, and a word may be of any length; phrases tied in
    score and count come in byte order; an empty table gives no rows, and so
    does a language without frequent phrases. Columns but lang and text are not
    read.
    """
    levels, totals = phrase_levels(docs, least, longest, most_bits)
    empty = docs.sparkSession.createDataFrame([], "lang string, phrase string, f long")
    longer = empty
    for level in levels[1:]:
        longer = longer.union(level)
    words = F.split("phrase", " ")
    found = longer.withColumn("words", words).withColumn("size", F.size("words"))
    shorter = levels[0]
    for level in levels[1:-1]:
        shorter = shorter.union(level)

    cuts = found.select("lang", "phrase", F.col("f").alias("a"), "words", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumn("first", _parts(F.col("words"), 1, F.col("k"))).withColumn("rest", _parts(F.col("words"), F.col("k") + 1, F.col("size") - F.col("k")))
    cuts = _of_parts(_of_parts(cuts.select("lang", "phrase", "a", "k", "first", "rest"), "first", shorter, "l"), "rest", shorter, "r")
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    score = F.expr("cast(cast(a as decimal(20,0)) * 2000000bd div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as bigint)")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    scored = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), lowest)

    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: _parts(F.col("words"), i, m))))
    inside = found.where("size > 2").select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), "f")
    most = inside.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = scored.join(most, ["lang", "phrase"], "left").where(F.coalesce(wide("longer"), F.lit(0)) * 100 < wide("a") * covered)
    kept = materialize(kept.select("lang", "phrase", "a", "cut.score", "cut.l", "cut.r"), "scored")

    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    rank = F.row_number()
    # the best of each share of a language first, so that no task sorts all of its phrases
    shares = max(1, kept.count() // (16 * top))
    share = F.pmod(F.xxhash64("phrase"), F.lit(shares))
    best = kept.withColumn("share", share).withColumn("rank", rank.over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", rank.over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def collocations_sql(least: int = 30, longest: int = 4, top: int = 2000, covered: int = 80) -> str:
    """The same in SQL, counting every phrase."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    spans = " UNION ALL ".join(f"SELECT lang, {k} AS size, array_to_string(w[i:i+{k - 1}], ' ') AS phrase FROM (SELECT lang, w, unnest(range(1, len(w) - {k - 2})) AS i FROM pieces WHERE len(w) >= {k})" for k in range(1, longest + 1))
    cuts = " UNION ALL ".join(f"SELECT lang, phrase, f AS a, {k} AS k, array_to_string(w[:{k}], ' ') AS p, array_to_string(w[{k + 1}:], ' ') AS q FROM cand WHERE size > {k}" for k in range(1, longest))
    inside = " UNION ALL ".join(f"SELECT lang, f, array_to_string(w[i:i+{m - 1}], ' ') AS phrase FROM (SELECT lang, f, w, unnest(range(1, size - {m - 2})) AS i FROM cand WHERE size > {m})" for m in range(2, longest))
    return f"""
    WITH pieces AS (
      SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w
      FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
    counts AS (SELECT lang, size, phrase, count(*) AS f FROM ({spans}) GROUP BY ALL),
    totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE size = 1 GROUP BY lang),
    cand AS (SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE size > 1 AND f >= {least}),
    scored AS (
      SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, ((2000000::HUGEINT * c.a) // (x.f + y.f))::BIGINT AS score
      FROM ({cuts}) c JOIN counts x ON x.lang = c.lang AND x.phrase = c.p JOIN counts y ON y.lang = c.lang AND y.phrase = c.q),
    lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    covers AS (SELECT lang, phrase, max(f) AS longer FROM ({inside}) GROUP BY ALL),
    kept AS (SELECT lowest.* FROM lowest LEFT JOIN covers USING (lang, phrase) WHERE 100::HUGEINT * coalesce(longer, 0) < {covered}::HUGEINT * a)
    SELECT lang, rank, phrase, a, l, r, n, score
    FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN totals USING (lang)
    WHERE rank <= {top}"""
