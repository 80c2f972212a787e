"""Full-text search: prefix terms and phrases over token columns, ranked by BM25."""

from __future__ import annotations

import re
import unicodedata
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.strings import MARKED, PLAIN, search_tokens
from ..sources.scratch import written

_PLAIN = str.maketrans(MARKED[: len(PLAIN)], PLAIN, MARKED[len(PLAIN) :])

#: BM25's parameters (fixed values).
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def clean_terms(query: str) -> list[list[str]]:
    """The phrases of a query: each blank-separated term without punctuation, cut into the tokens that texts have, its last token a prefix.

    A term without letters or digits is dropped; a query without terms matches nothing.
    """
    out = []
    for term in query.split():
        kept = "".join(c for c in term if c.isalnum() or c == "_" or unicodedata.combining(c))
        tokens = re.findall(r"[^\W_]+", kept.lower().translate(_PLAIN))
        if tokens:
            out.append(tokens)
    return out


def _frequency(tokens: Column, phrase: list[str]) -> Column:
    """How often a phrase occurs in an array of tokens, which the array around them has made once for all places."""
    return F.transform(F.array(tokens), lambda t: _count_of(t, phrase))[0]


def _count_of(tokens: Column, phrase: list[str]) -> Column:
    if len(phrase) == 1:
        return F.size(F.filter(tokens, lambda t: t.startswith(phrase[0])))
    n = len(phrase)
    fits = lambda i: [*[F.get(tokens, i + k) == p for k, p in enumerate(phrase[:-1])], F.get(tokens, i + n - 1).startswith(phrase[-1])]

    def all_of(i):
        out = F.lit(True)
        for f in fits(i):
            out = out & f
        return out

    places = F.sequence(F.lit(0), F.size(tokens) - n)
    return F.when(F.size(tokens) < n, 0).otherwise(F.size(F.filter(places, all_of)))


def _score(n: Column, mean: Column, df: Column, tf: Column, length: Column) -> Column:
    """BM25 of one phrase in one document."""
    idf = F.log((n - df + 0.5) / (df + 0.5))
    return F.when(idf > 0, idf).otherwise(LEAST_IDF) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def search(docs: DataFrame, query: str, columns: tuple[str, ...], match_all: bool = True) -> DataFrame:
    """``docs`` that match with ``bm25``, negative and least for the best; a scan, for tables without an index.

    A document has the tokens of all ``columns``; phrases don't go over from one
    column to the next. ``match_all``: every phrase has to occur, else one. The
    texts are tokenised once: the corpus figures (documents, mean length,
    documents of each phrase) are observed while the hits are written.
    """
    phrases = clean_terms(query)
    if not phrases:
        return docs.limit(0).withColumn("bm25", F.lit(0.0))
    tokens = docs.withColumns({f"__t{k}": search_tokens(F.coalesce(c, F.lit(""))) for k, c in enumerate(columns)})
    texts = [F.col(f"__t{k}") for k in range(len(columns))]
    tf = [sum((_frequency(t, p) for t in texts[1:]), _frequency(texts[0], p)) for p in phrases]
    length = sum((F.size(t) for t in texts[1:]), F.size(texts[0]))
    counted = tokens.withColumns({"__length": length, **{f"__tf{k}": t for k, t in enumerate(tf)}}).drop(*[f"__t{k}" for k in range(len(columns))])
    sums = Observation(f"search-{uuid.uuid4().hex}")
    counted = counted.observe(sums, F.count(F.lit(1)).alias("n"), F.avg("__length").alias("mean"), *[F.count_if(F.col(f"__tf{k}") > 0).alias(f"df{k}") for k in range(len(tf))])
    hit = F.col("__tf0") > 0
    for k in range(1, len(tf)):
        hit = (hit & (F.col(f"__tf{k}") > 0)) if match_all else (hit | (F.col(f"__tf{k}") > 0))
    rows, figures = written(counted.where(hit), "hits"), sums.get
    part = lambda k: _score(F.lit(float(figures["n"])), F.lit(figures["mean"]), F.lit(figures[f"df{k}"]), F.col(f"__tf{k}"), F.col("__length"))
    score = sum((part(k) for k in range(1, len(tf))), part(0))
    return rows.select(*docs.columns, (-score).alias("bm25"))


#: Places of one column's tokens begin so far from the next column's, so no phrase goes over.
_COLUMN = 1 << 32


def _grouped(batches):
    """A document's tokens, a list a column, as its tokens in order, each once with its places; all documents of a batch at once."""
    for b in batches:
        lists, n = b.columns[1:], b.num_rows
        sizes = [pc.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in lists]
        row = np.concatenate([np.repeat(np.arange(n), m) for m in sizes])
        place = np.concatenate([k * _COLUMN + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) for k, m in enumerate(sizes)])
        words = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
        key = row * max(1, len(words.dictionary)) + words.indices.to_numpy()
        order = np.argsort(key, kind="stable")  # places stay in order
        first = np.flatnonzero(np.diff(key[order], prepend=-1))
        token = words.dictionary.take(words.indices.take(pa.array(order[first])))
        places = pa.ListArray.from_arrays(np.append(first, len(key)).astype(np.int32), pa.array(place[order]))
        each = pa.StructArray.from_arrays([token, places], ["token", "places"])
        ends = np.searchsorted(row[order][first], np.arange(n + 1)).astype(np.int32)
        length = pa.array(sum(sizes).astype(np.int32))
        yield pa.RecordBatch.from_arrays([b.column(0), length, pa.ListArray.from_arrays(ends, each)], ["id", "length", "postings"])


def terms(docs: DataFrame, columns: tuple[str, ...], id: str = "id") -> DataFrame:
    """(id, length, postings) of every document: each of its tokens once, with its places. A document is cut and grouped by itself, so no rows move."""
    tokens = docs.select(F.col(id).alias("id"), *[search_tokens(F.coalesce(F.col(c), F.lit(""))).alias(f"t{k}") for k, c in enumerate(columns)])
    return tokens.mapInArrow(_grouped, f"id {tokens.schema['id'].dataType.simpleString()}, length int, postings array<struct<token:string,places:array<bigint>>>")


def postings(docs: DataFrame, columns: tuple[str, ...], id: str = "id") -> tuple[DataFrame, DataFrame]:
    """The index of ``docs``: (token, id, places), sorted by token in runs of tokens, and (id, length) of every document.

    Written with one range of (token, id) to a file, so a word that very many
    documents hold goes over several, and Parquet's figures let a search read
    the files and row groups of its prefixes alone. Postings move once, to
    their range.
    """
    return postings_of(terms(docs, columns, id))


def postings_of(held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``postings`` from the rows of ``terms``; where both tables are used, and as ranges are sampled first, these are best written."""
    found = held.select("id", F.explode("postings").alias("t")).select("t.token", "id", "t.places")
    return found.repartitionByRange("token", "id").sortWithinPartitions("token", "id"), held.select("id", "length")


def search_postings(index: DataFrame, lengths: DataFrame, query: str, match_all: bool = True) -> DataFrame:
    """(id, bm25) of the documents that match, from the tables of ``postings``; the same figures as ``search``.

    What is read of the index are the tokens of the query; of documents, those
    that hold one. A document frequency is a row for each phrase.
    """
    phrases = clean_terms(query)
    if not phrases:
        return lengths.select("id", F.lit(0.0).alias("bm25")).limit(0)
    fits = [(k, at, len(p), (F.col("token").startswith(t) if at == len(p) - 1 else F.col("token") == t)) for k, p in enumerate(phrases) for at, t in enumerate(p)]
    any_of = fits[0][3]
    for *_, f in fits[1:]:
        any_of = any_of | f
    uses = F.filter(F.array(*[F.when(f, F.struct(F.lit(k).alias("phrase"), F.lit(at).alias("at"), F.lit(n).alias("n"))) for k, at, n, f in fits]), lambda u: u.isNotNull())
    used = index.where(any_of).select("id", "places", F.explode(uses).alias("u")).select("id", "places", "u.*")
    single = used.where("n = 1").groupBy("phrase", "id").agg(F.sum(F.size("places")).alias("tf"))
    starts = used.where("n > 1").select("phrase", "id", "n", F.explode(F.transform("places", lambda p: p - F.col("at"))).alias("start"))
    whole = starts.groupBy("phrase", "id", "n", "start").agg(F.count("*").alias("met")).where("met = n")
    tf = single.union(whole.groupBy("phrase", "id").agg(F.count("*").alias("tf")))
    tf = written(tf, "frequencies")
    figures = lengths.agg(F.count("*").cast("double").alias("n"), F.avg("length").alias("mean"))
    known = tf.groupBy("phrase").agg(F.count("*").alias("df")).join(F.broadcast(figures))  # a row for each phrase of the query
    scored = tf.join(lengths, "id").join(F.broadcast(known), "phrase")
    hits = scored.groupBy("id").agg(F.count("*").alias("met"), (-F.sum(_score(F.col("n"), F.col("mean"), F.col("df"), F.col("tf"), F.col("length")))).alias("bm25"))
    return hits.where(F.col("met") == len(phrases) if match_all else F.lit(True)).select("id", "bm25")
