import random
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spindrift.llm import packing
from spindrift.llm.queries import TOKENIZER

from .conftest import DOCS


def ids_of(text):
    return Tokenizer.from_file(TOKENIZER["tokenizer_path"]).encode(text or "", add_special_tokens=False).ids + [2]


@pytest.mark.parametrize("ranks", [True, False])
def test_pieces_equal_whole_text_encoding(docs, ranks):
    how = TOKENIZER if ranks else {"tokenizer_path": TOKENIZER["tokenizer_path"]}
    got = packing.pack_documents(docs, keep_ids=True, **how).collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        assert r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length
    for i, text, *_ in {d[0]: d for d in DOCS}.values():
        want = b"".join(x.to_bytes(4, "little") for x in ids_of(text))
        rows = sorted(by[i], key=lambda r: r.piece)[:: 2 if i == 10 else 1]
        assert b"".join(bytes(r.ids) for r in rows) == want
        assert [r.start for r in rows] == [sum(x.length for x in rows[:k]) for k in range(len(rows))]
        assert all(r.length == 1024 for r in rows[1:])
    assert len(by[10]) == 2


def check(rows, size):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for v in by.values():
        v.sort()
        assert v[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(v, v[1:])) and sum(n for _, n in v) <= size
    return len(by)


def test_sequences_are_full(spark):
    rng = random.Random(1)
    rows = [(k, 0, 0, rng.choice([rng.randint(1, 1024), rng.randint(1, 200)]), "x") for k in range(20_000)]
    df = spark.createDataFrame(rows, "doc_id long, start long, piece int, length long, offset string")
    got = packing.pack(df, 2).collect()
    assert sorted((r.doc_id, r.length) for r in got) == sorted((r[0], r[3]) for r in rows)
    assert check(got, 1024) <= 1.01 * sum(r[3] for r in rows) / 1024 + 2


def test_bins_fit_best_and_close_the_fullest():
    bins = packing.OpenBins(10, 2)
    assert bins.place(6) == (0, 0)
    assert bins.place(7) == (1, 0)
    assert bins.place(3) == (1, 7)  # the least space that is enough; then it is full
    assert bins.place(5) == (2, 0)
    assert bins.place(9) == (3, 0)  # bin 0 had less space than bin 2: it closes
    assert bins.place(4) == (2, 5)
    assert bins.place(1) == (2, 9) or bins.place(1) == (3, 9)


def test_sequences_join_ids(docs, no_docs):
    packed = packing.pack_documents(docs.where("doc_id < 6"), keep_ids=True, **TOKENIZER)
    whole = {r.sequence_id: bytes(r.ids) for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert whole[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids)
    assert packing.pack_documents(no_docs, **TOKENIZER).count() == 0


def test_extra_columns(docs):
    more = docs.withColumn("length", F.lit("x")).withColumn("ids", F.lit(1)).withColumn("sequence_id", F.lit(2))
    assert packing.pack_documents(more, **TOKENIZER).count() == packing.pack_documents(docs, **TOKENIZER).count()
    assert public_tokenizers.path("byte_bpe_50k.json") == TOKENIZER["tokenizer_path"]
