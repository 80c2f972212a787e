import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spindrift.llm import bitpack
from spindrift.llm.queries import TOKENIZER
from spindrift.sources import scratch

from .conftest import DOCS, SCHEMA


@pytest.mark.parametrize("bits", [1, 2, 3, 5, 7, 8, 11, 13, 16, 17, 24, 31, 32])
def test_any_span_of_any_width(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 7, 8, 9, 1000, 2 * bitpack._STRIP + 3):
        ids = rng.integers(0, 1 << bits, n, dtype=np.uint64).astype("<u4")
        data = bitpack.pack_ids(ids, bits)
        assert len(data) == -(-n * bits // 8)
        assert (bitpack.unpack_ids(data, bits, 0, n) == ids).all()
        # against Python's own big integer
        if n <= 1000:
            assert int.from_bytes(data, "little") == sum(int(x) << (bits * i) for i, x in enumerate(ids))
        for _ in range(20):
            a, b = sorted(rng.integers(0, n + 1, 2).tolist())
            assert (bitpack.unpack_ids(data, bits, a, b - a) == ids[a:b]).all()


def test_width_and_ids_that_do_not_fit():
    assert [bitpack.width_of(v) for v in (1, 2, 3, 4, 5, 256, 257, 50257, 65536, 65537)] == [1, 1, 2, 2, 3, 8, 9, 16, 16, 17]
    for bits in (3, 16):
        with pytest.raises(ValueError):
            bitpack.pack_ids(np.array([1 << bits], "<u4"), bits)


def ids_of(text):
    return Tokenizer.from_file(TOKENIZER["tokenizer_path"]).encode(text or "", add_special_tokens=False).ids + [2]


def written(spark, docs, **how):
    path = scratch.path(spark, "ids")
    bitpack.write_ids(docs, path, **(TOKENIZER | how))
    return path


def check(got, rows):
    """Rows by start against the texts in ascending order of ids; equal ids in any order."""
    at, left = 0, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in got] == [r[0] for r in left]
    bodies = {}
    for r in got:
        assert r.start == at and len(r.ids) == 4 * r.n_tokens
        at += r.n_tokens
        bodies.setdefault(r.doc_id, []).append(bytes(r.ids))
    want = {}
    for i, text, *_ in left:
        want.setdefault(i, []).append(np.array(ids_of(text), "<u4").tobytes())
    assert {i: sorted(v) for i, v in bodies.items()} == {i: sorted(v) for i, v in want.items()}
    return at


@pytest.mark.parametrize("how", [{}, {"block_tokens": 50, "shard_bytes": 20_000}, {"ranks_path": None}])
def test_files_give_back_every_document(spark, docs, how):
    path = written(spark, docs, **how)
    got = bitpack.read_ids(spark, path).orderBy("start").collect()
    check(got, DOCS)
    digests = {(r.doc_id, r.start): r for r in bitpack.digests(spark, path).collect()}
    assert all(digests[r.doc_id, r.start].ids_crc32 == zlib.crc32(r.ids) and digests[r.doc_id, r.start].n_tokens == r.n_tokens for r in got)
    if "shard_bytes" in how:
        assert spark.read.parquet(f"{path}/shards").count() > 3


def test_random_access(spark, docs):
    path = written(spark, docs, block_tokens=50, shard_bytes=20_000)
    rows = bitpack.read_ids(spark, path).orderBy("start").collect()
    whole = np.concatenate([np.frombuffer(r.ids, "<u4") for r in rows])
    rng = np.random.default_rng(2)
    for a, b in [(0, len(whole)), (len(whole) - 3, len(whole) + 50), *np.sort(rng.integers(0, len(whole), (4, 2)), axis=1).tolist()]:
        assert (bitpack.read_span(spark, path, a, b - a) == whole[a:b]).all()
    some = bitpack.read_documents(spark, path, [8, 10, 77]).orderBy("start").collect()
    assert some == [r for r in rows if r.doc_id in (8, 10)]


def test_one_id_and_repeated_rows_over_many_shards(spark):
    rows = [(7, "the same words again and again", "en", "a", 1)] * 600 + [(None, f"text {k}", "en", "a", 1) for k in range(600)]
    path = written(spark, spark.createDataFrame(rows, SCHEMA), shard_bytes=2500, block_tokens=64)
    check(bitpack.read_ids(spark, path).orderBy("start").collect(), rows)
    shards = spark.read.parquet(f"{path}/shards").collect()
    assert len(shards) > 8 and max(r.n_tokens for r in shards) < 0.4 * sum(r.n_tokens for r in shards)


def test_empty_table_and_clashing_columns(spark, docs, no_docs):
    path = written(spark, no_docs)
    assert bitpack.digests(spark, path).collect() == []
    assert len(bitpack.read_span(spark, path, 0, 5)) == 0
    for name in ("n_tokens", "data", "shard", "hash", "number", "ids"):
        docs = docs.withColumn(name, F.lit("mine"))
    check(bitpack.read_ids(spark, written(spark, docs)).orderBy("start").collect(), DOCS)
