import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from perigee.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    (1, "Hello world, it's 2024!"), (2, ""), (3, None), (None, "no id"), (1, "Hello world, it's 2024!"), (4, "<|endoftext|>mid<|startoftext|> ﬁ É é\x1c\x85 x y ǅ Σς"),
    (5, "long " * 9000), (6, "a\x0bb\x0cc\r\nd\te"), (7, "İstanbul ΑΣ é ́x"), (8, "don't we'll 12345 ?!?... ​"),
]


@pytest.mark.parametrize("parts", [1, 3])
def test_round_trip_and_windows(spark, parts):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("part", F.lit("x")).withColumn("n", F.lit(1)).repartition(parts)
    rows = packing.pack(docs, PATH, length=64).collect()
    tok = Tokenizer.from_file(PATH)
    want = sorted((str(i), [*tok.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in TEXTS)
    docs_at = sorted(rows, key=lambda r: (r.sequence_id, r.offset))
    got, one = [], []
    for r in docs_at:
        assert r.start == len(one) and r.length > 0
        one += np.frombuffer(r.ids, "<u4").tolist()
        if len(one) == r.doc_tokens:
            got.append((str(r.id), one))
            one = []
    assert sorted(got) == want
    at = [r.sequence_id * 64 + r.offset for r in docs_at]
    assert at == np.cumsum([0, *(r.length for r in docs_at)])[:-1].tolist()
    assert all(r.offset + r.length <= 64 for r in rows)


def test_sequences_and_empty(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    rows = packing.sequences(packing.pack(docs, PATH, length=64), 64).orderBy("sequence_id").collect()
    assert all(len(r.ids) == 256 for r in rows[:-1])
    assert rows[-1].n == 64 or len(rows[-1].ids) == (4 * rows[-1].n if rows[-1].n & (rows[-1].n - 1) == 0 else 256)
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_query_digest(spark):
    from perigee.llm.queries import op6_packing

    tok = Tokenizer.from_file(PATH)
    rows = op6_packing(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    ids = {i: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in texts.items()}
    assert {r.doc_id for r in rows} == set(texts) and sum(r.length for r in rows) == sum(map(len, ids.values()))
    for r in rows:
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
