from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from spindrift.llm import mixing, packing, queries

from .conftest import DOCS
from .test_packing import check, ids_of
from .test_simhash import similar_groups


def test_stages_on_the_small_table(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet").cache()
    known = corpus_pipeline.known_language(spark, docs, small)
    ids = {r.doc_id: r.text for r in known.collect()}
    assert len(ids) >= 0.97 * docs.count()
    single = corpus_pipeline.one_of_near_copies(spark, known, small)
    got = {r.doc_id for r in single.collect()}
    groups = similar_groups(list(ids.items()))
    assert got == {min(i for i, g in zip(ids, groups) if g == one) for one in set(groups)}
    assert single.columns == docs.columns
    clean = corpus_pipeline.pseudonyms(spark, single, small)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == got
    assert clean.where("n_chars <> length(text)").count() <= docs.where("n_chars <> length(text)").count()
    mixed = corpus_pipeline.target_mix(spark, clean, small)
    copies = Counter(r.doc_id for r in mixed.collect())
    assert set(copies) == got and mixed.columns == docs.columns
    text = {r.doc_id: r.text for r in clean.collect()}
    mixed.write.parquet(str(tmp_path / "mixed"))
    again = spark.read.parquet(str(tmp_path / "mixed"))
    line = [r.doc_id for r in packing.in_file_order(again).orderBy("place").collect()]
    assert line == [r.doc_id for r in mixing.mix(clean).orderBy("position").collect()]
    rows = corpus_pipeline.packed(spark, again, small).collect()
    check(rows, 1024)
    assert sum(r.length for r in rows) == sum(len(ids_of(text[i])) * n for i, n in copies.items())


def test_run_on_odd_documents(spark, docs, no_docs, tmp_path):
    for name, df in (("odd", docs), ("none", no_docs)):
        d = str(tmp_path / name)
        df.coalesce(1).write.parquet(f"{d}/documents.parquet")
        rows = corpus_pipeline.run(spark, d).collect()
        assert (len(rows) > 0) == (name == "odd")
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()} <= {d[0] for d in DOCS}


def test_clashing_columns(spark, docs, tmp_path):
    """Columns that have the names of what a stage makes come back with their own values."""
    names = ("language", "confidence", "text_language", "n_replaced", "fingerprint", "place", "group", "piece", "epoch", "slot", "position", "release")
    more = docs.select("*", *(F.lit(f"own {c}").alias(c) for c in names))
    more.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    found = more
    for _, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, found, "")
        assert found.columns == more.columns
    rows = found.collect()
    assert rows and all(r[c] == f"own {c}" for r in rows for c in names)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_repeats_lie_apart(spark, tmp_path):
    """A small source's documents come again, and no sequence has two of one document."""
    rows = [(k, f"text {k} " + "word " * (60 + k % 9), "en", "big", 0) for k in range(3000)] + [(10_000 + k, f"rare {k} " + "term " * 60, "en", "small", 0) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    mixed = corpus_pipeline.target_mix(spark, docs, "")
    mixed.write.parquet(str(tmp_path / "mixed"))
    packed = corpus_pipeline.packed(spark, spark.read.parquet(str(tmp_path / "mixed")), "").collect()
    again = {i for i, n in Counter(r.doc_id for r in packed).items() if n > 1}
    both = Counter((r.sequence_id, r.doc_id) for r in packed)
    assert len(again) >= 40 and sum(n > 1 for n in both.values()) <= 2


def test_registered():
    names = {f"op{n}_" for n in range(1, 11)}
    assert names == {k.split("_")[0] + "_" for k in queries.QUERIES}
    assert [len(corpus_pipeline.STAGES), corpus_pipeline.ORACLE_SQL] == [5, None]
