"""The corpus pipeline: raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before
kept; all but the last return the columns of ``documents``.

In every stage null and empty texts, sources and languages are values like
others, texts are read whole, rows without an id take part, and an empty table
gives an empty table. Columns beside those of ``documents`` come along with
their values, whatever their names, but for names that begin with ``__``, which
may not be there.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import langid, mixing, packing, pii, simhash
from spindrift.llm.common import materialize, table
from spindrift.llm.queries import PII_KEY, TOKENIZER


def _beside(docs: DataFrame, names: tuple, stage) -> DataFrame:
    """``stage(docs)``, in which columns of ``docs`` that have one of ``names``, which the stage makes itself, are called otherwise; they come back as they were."""
    own = {c: f"own__{c}" for c in docs.columns if c in names}
    return stage(docs.withColumnsRenamed(own)).drop(*own).withColumnsRenamed({v: k for k, v in own.items()}).select(docs.columns)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose text is in no known language; null and empty texts are in none."""
    made = ("language", "confidence", "text_language", "text_confidence")
    return _beside(docs, made, lambda d: langid.known_language(d, langid.train(docs)))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the smallest id: five-word shingles, a Jaccard similarity of 0.8 or more."""
    return simhash.keep_one(docs, width=5, similarity=0.8)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With pseudonyms for personal data; n_chars follows the text. Every row stays."""

    def stage(d: DataFrame) -> DataFrame:
        done = pii.pseudonymise(d, PII_KEY)
        return done.withColumn("n_chars", F.when(F.col("n_replaced") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))

    return _beside(docs, ("n_replaced",), stage)


def target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target weights, in the order of the schedule: rows of small sources come again, as often as it asks for them."""
    made = ("epoch", "block", "slot", "release", "deadline", "position")
    return _beside(docs, made, lambda d: mixing.mix(d).repartitionByRange("position").sortWithinPartitions("position"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each document in the training sequences.

    A table that the stage before has written is packed in the order of its
    rows, so sequences hold what the schedule puts together, and repeats of a
    document lie as far apart as there; any other table in hash order.
    """
    try:
        docs = packing.in_file_order(docs, "__place")
    except AnalysisException:  # no table of files
        return packing.pack_documents(docs, **TOKENIZER)
    return packing.pack_documents(docs, place="__place", **TOKENIZER)


STAGES = [("language", known_language), ("near_copies", one_of_near_copies), ("pii", pseudonyms), ("mixing", target_mix), ("packing", packed)]

#: SQL has no trigram model, keyed permutation or tokenizer; tests hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
