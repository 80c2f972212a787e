"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import backoff, bitpack, centroids, chat, langid, mixing, packing, phrases, pii, simhash, sketches, toxicity, vectors
from ..sources import scratch
from .common import doc_bucket, in_small_batches, materialize, table


TOKENIZER = {"tokenizer_path": public_tokenizers.path("byte_bpe_50k.json"), "ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}
#: For tests and figures; production takes its key from a secret store.
PII_KEY = "an example key"


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs)


def op2_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return backoff.score_texts(docs, doc_bucket(F.col("doc_id"), 7) != 2)


def op3_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, PII_KEY)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.fingerprint_versions(table(spark, sf_dir, "documents"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = langid.train(table(spark, sf_dir, "documents"))
    pages = langid.identify_pages(table(spark, sf_dir, "pages"), model)
    return pages.select("page_id", "language", "confidence", "text_language", "text_confidence")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), **TOKENIZER)


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_chats(turns.union(extra)))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = doc_bucket(F.col("doc_id"), 5) == 0
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    with in_small_batches(spark):
        scored = materialize(docs.select("doc_id", held_out.alias("held_out"), toxicity.score(model)("text").alias("score")), "scores")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return near.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op11_yinyang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings")).drop("n_distances")


def op12_bitpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.path(spark, "token-ids")
    bitpack.write_ids(table(spark, sf_dir, "documents"), path, **TOKENIZER)
    return bitpack.digests(spark, path)


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES = {"op1_mixing": op1_mixing, "op2_backoff": op2_backoff, "op3_vectors": op3_vectors, "op4_pii": op4_pii, "op6_fingerprints": op6_fingerprints, "op7_langid": op7_langid, "op5_packing": op5_packing, "op8_chat": op8_chat, "op9_toxicity": op9_toxicity, "op10_simhash": op10_simhash, "op11_yinyang": op11_yinyang, "op12_bitpack": op12_bitpack, "op13_phrases": op13_phrases}
ORACLE_SQL: dict[str, str] = {"op11_yinyang": centroids.cluster_sql(), "op13_phrases": phrases.collocations_sql()}
