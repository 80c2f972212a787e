"""Language identification by Bayesian fusion of text, markup and address evidence."""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches, materialize

BUCKETS = 1 << 16
UNKNOWN = "und"
_STEP = 1 << 20


def _letters() -> np.ndarray:
    """Bytes as the model sees them: letters in lower case, bytes of other scripts as they are, the rest as blanks."""
    out = np.full(256, 32, np.uint32)
    out[128:] = np.arange(128, 256)
    out[97:123] = np.arange(97, 123)
    out[65:91] = np.arange(97, 123)
    return out


_BYTE = _letters()


def trigrams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each byte trigram, and whether it has a letter."""
    b = _BYTE[data]
    code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16), code != 0x202020


def _offsets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = texts.fill_null("").cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    return at, np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)


def _sums(texts: pa.Array, values: list) -> np.ndarray:
    """For each text the sum over its trigrams with a letter of each of ``values``; the last column counts them."""
    at, data = _offsets(texts)
    out = np.zeros((len(texts), len(values) + 1))
    for a in range(int(at[0]), max(int(at[0]), int(at[-1]) - 2), _STEP):
        b = min(int(at[-1]) - 2, a + _STEP)
        bucket, good = trigrams(data[a : b + 2])
        first, last = np.searchsorted(at, a, "right") - 1, np.searchsorted(at, b, "left")
        for end in at[first + 1 : last + 1]:  # no trigram goes over a text's end
            good[max(0, end - 2 - a) : max(0, end - a)] = False
        lo, hi = np.clip(at[first:last], a, b) - a, np.clip(at[first + 1 : last + 1], a, b) - a
        for k, table in enumerate([*values, None]):
            run = np.cumsum(good if table is None else np.where(good, table[bucket], 0.0), dtype=np.float64)
            run = np.r_[0.0, run]
            out[first:last, k] += run[hi] - run[lo]
    return out


log = logging.getLogger(__name__)
#: The language of all labels that are too rare to be learned one by one.
OTHER = "other"


@dataclass
class TextModel:
    languages: list[str]
    log_p: np.ndarray

    def evidence(self):
        """A column function: text to the log-likelihood under each language and under evenly spread trigrams, then their number."""
        tables, even = list(self.log_p), float(-np.log(BUCKETS))

        @F.arrow_udf("array<double>")
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for texts in batches:
                s = _sums(texts, tables)
                rows = np.column_stack([s[:, :-1], s[:, -1] * even, s[:, -1]])
                yield pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), rows.shape[1]).cast(pa.list_(pa.float64()))

        return run


def train(labelled: DataFrame, per_language: int = 2_000, smoothing: float = 0.5, most_languages: int = 256) -> TextModel:
    """A trigram model of each value of ``lang`` from about ``per_language`` of its rows, drawn by hash of doc_id; whole texts.

    Every language that has a row is learned, whatever its share of the table:
    all rows of a rare one, and always those of a language's smallest hash. Rows
    with a null text or language teach nothing. Where ``lang`` has more than
    ``most_languages`` values (dirty labels may be any number), those with the
    fewest rows are learned together, as the language `OTHER`, and their number
    is logged. Repeated rows teach as often as they come. Without any row the
    model has no language and everything is unknown.
    """
    rows = labelled.where("lang is not null and text is not null").select("lang", "text", F.xxhash64(F.lit("lang"), "doc_id").alias("hash"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("hash").alias("least")).orderBy(F.desc("n"), "lang").limit(most_languages + 1).collect()
    merged = len(sizes) > most_languages
    sizes = sizes[: most_languages - merged]
    steps = labelled.sparkSession.createDataFrame([(r["lang"], -(-r["n"] // per_language), r["least"]) for r in sizes], "lang string, step long, least long")
    drawn = rows.join(F.broadcast(steps), "lang").where("pmod(hash, step) = 0 or hash = least").select("lang", "text")
    if merged:
        rest = rows.join(F.broadcast(steps), "lang", "left_anti")
        of = rest.agg(F.count("*").alias("n"), F.min("hash").alias("least"), F.approx_count_distinct("lang").alias("values")).first()
        log.warning("about %d values of lang with %d rows are learned as one language", of["values"], of["n"])
        step = -(-of["n"] // per_language)
        drawn = drawn.union(rest.where((F.pmod("hash", F.lit(step)) == 0) | (F.col("hash") == of["least"])).select(F.lit(OTHER), "text"))

    def count(batches):
        seen: dict = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                data = np.frombuffer(text.as_py().encode(), np.uint8)
                for a in range(0, max(0, len(data) - 2), _STEP):
                    bucket, good = trigrams(data[a : a + _STEP + 2])
                    seen[lang] = seen.get(lang, 0) + np.bincount(bucket[good], minlength=BUCKETS)
        for lang, n in seen.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(n[at])], ["lang", "bucket", "n"])

    with in_small_batches(labelled.sparkSession):  # at most a row for each language and bucket
        table = drawn.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(table.column("lang").to_pylist()))
    counts = np.zeros((len(langs), BUCKETS))
    row = np.searchsorted(np.array(langs), np.array(table.column("lang").to_pylist())) if langs else np.empty(0, int)
    counts[row, table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    log_p = np.log(counts + smoothing) - np.log((counts + smoothing).sum(1, keepdims=True))
    return TextModel(langs, log_p)


def _softmax(logs: Column) -> Column:
    weights = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(weights, lambda x: x / F.aggregate(weights, F.lit(0.0), lambda a, y: a + y))


def _sum_by(rows: DataFrame, key: str, n: int, name: str) -> DataFrame:
    """(key, array of the sums of each class's share)."""
    sums = [F.sum(F.col("__share")[k]) for k in range(n)]
    return rows.groupBy(key).agg(F.array(*sums).alias(name))


def identify(
    rows: DataFrame,
    model: TextModel,
    text: Column,
    declared: Column,
    suffix: Column,
    host: Column,
    temper: float = 0.3,
    strength: float = 10.0,
) -> DataFrame:
    """``rows`` with ``language`` and ``confidence``, ``text_language`` and ``text_confidence``.

    For each language: likelihood of the text (tempered, as trigrams overlap),
    probability of the declared language given the true one, and the host's
    prior. All but the first are grouped sums of the text's shares over all
    rows: of declared by language; of hosts, smoothed by ``strength`` rows to
    their suffix, and suffixes to the whole. A row's own share is taken out of
    its host's and suffix's prior. "und" is a class of its own, with evenly
    spread trigrams; a text without letters, an empty or a null one is always
    "und". Null or unknown declared values, suffixes and hosts are groups of
    their own. Of equally likely languages the first by name is taken. Repeated
    rows count as often as they come, texts are read whole, an empty table gives
    no rows. Columns of ``rows`` with one of the new names, or that begin with
    ``__``, are replaced. Rows are written with their evidence, so each text goes to Python once.
    """
    new = ("language", "confidence", "text_language", "text_confidence")
    rows = rows.drop(*(c for c in rows.columns if c in new or c.startswith("__")))
    classes = [*model.languages, UNKNOWN]
    n = len(classes)
    names = F.array(*map(F.lit, classes))
    code = F.lower(F.substring_index(declared.cast("string"), "-", 1))
    place = F.array_position(names, F.when(code == UNKNOWN, None).otherwise(code))
    known = (
        rows.withColumn("__e", model.evidence()(text))
        .withColumn("__declared", F.when(code.isNull() | (code == ""), n + 1).when(place > 0, place.cast("int") - 1).otherwise(n))
        .withColumn("__suffix", F.coalesce(suffix.cast("string"), F.lit("")))
        .withColumn("__host", F.coalesce(host.cast("string"), F.lit("")))
    )
    empty = F.col("__e")[n] == 0
    known = known.withColumn("__log", F.transform(F.slice("__e", 1, n), lambda x: x * temper))
    known = known.withColumn("__share", F.when(empty, F.array(*[F.lit(float(k == n - 1)) for k in range(n)])).otherwise(_softmax(F.col("__log"))))

    with in_small_batches(rows.sparkSession):
        known = materialize(known, "evidence")

    by_host = known.select("__host", "__suffix", "__declared", "__share")
    groups = by_host.groupBy("__host", "__suffix", "__declared").agg(F.array(*[F.sum(F.col("__share")[k]) for k in range(n)]).alias("__share"))
    groups = materialize(groups, "groups")
    by_declared = {r["__declared"]: r["s"] for r in _sum_by(groups, "__declared", n, "s").collect()}
    total = [sum(s[k] for s in by_declared.values()) for k in range(n)]
    whole = sum(total) + n
    prior = [(t + 1) / whole for t in total]
    told = [[float(np.log((by_declared.get(d, [0.0] * n)[k] + 0.5 + 2.0 * (d == k)) / (total[k] + 0.5 * (n + 2) + 2.0))) for k in range(n)] for d in range(n + 2)]
    suffixes = _sum_by(groups, "__suffix", n, "__by_suffix")
    hosts = groups.groupBy("__host", "__suffix").agg(F.array(*[F.sum(F.col("__share")[k]) for k in range(n)]).alias("__by_host"))
    side = materialize(hosts.join(suffixes, "__suffix"), "hosts")

    told_of = F.array(*[F.array(*map(F.lit, t)) for t in told])[F.col("__declared")]
    out = known.join(side, ["__host", "__suffix"])
    less = lambda a: F.zip_with(a, F.col("__share"), lambda x, y: F.greatest(x - y, F.lit(0.0)))
    total_of = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    out = out.withColumn("__by_suffix", less(F.col("__by_suffix"))).withColumn("__by_host", less(F.col("__by_host")))
    smooth = lambda a, under: F.zip_with(a, under, lambda x, p: (x + strength * p) / (total_of(a) + strength))
    out = out.withColumn("__by_suffix", smooth(F.col("__by_suffix"), F.array(*map(F.lit, prior))))
    out = out.withColumn("__by_host", smooth(F.col("__by_host"), F.col("__by_suffix")))
    out = out.withColumn("__told", told_of)
    logs = F.zip_with(F.zip_with("__log", "__told", lambda x, y: x + y), F.col("__by_host"), lambda x, p: x + F.log(p))
    out = out.withColumn("__post", F.when(empty, F.col("__share")).otherwise(_softmax(logs)))
    best = lambda a: F.element_at(names, F.array_position(a, F.array_max(a)).cast("int"))
    return out.select(
        *rows.columns,
        best(F.col("__post")).alias("language"),
        F.array_max("__post").alias("confidence"),
        best(F.col("__share")).alias("text_language"),
        F.array_max("__share").alias("text_confidence"),
    )


_MARKUP = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^>]*>|&[#\w]+;"


def page_columns(html: Column, url: Column) -> dict[str, Column]:
    """Text, declared language, suffix and host of web pages."""
    tag = F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1)
    meta = F.regexp_extract(html, r"(?i)<meta\b[^>]*?content-language[^>]*?content\s*=\s*[\"']?([A-Za-z]{2,3})", 1)
    host = F.lower(F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return {"text": F.regexp_replace(html, _MARKUP, " "), "declared": F.when(tag != "", tag).otherwise(meta), "suffix": F.substring_index(host, ".", -1), "host": host}


def identify_pages(pages: DataFrame, model: TextModel) -> DataFrame:
    """``identify`` over a table with ``html`` and ``url``; either may be null."""
    return identify(pages, model, **page_columns(F.col("html"), F.col("url")))


def known_language(docs: DataFrame, model: TextModel, reject: float = 0.5) -> DataFrame:
    """The rows of ``docs`` (lang as declared, source as host) whose text is in some language of the model.

    A row goes if "und" is the likeliest, with a confidence over ``reject``.
    """
    found = identify(docs, model, F.col("text"), F.col("lang"), F.lit(None), F.col("source"))
    return found.where((F.col("language") != UNKNOWN) | (F.col("confidence") <= reject)).select(docs.columns)
