import random
import time

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from perigee.llm import token_counts
from perigee.llm.queries import op3_token_counts

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def counter():
    return token_counts.Counter(PATH, PATTERN)


def test_random_edits_equal_whole_encoding(counter):
    rng = random.Random(4)
    bits = ["a", "It's", "'", "'re", " ", "  ", "   ", "\n", " \n", "word", "é", "12", "!?", "they'll", "\t", "ß ", "x" * 30, "😀"]
    for turn in range(400):
        text = "".join(rng.choice(bits) for _ in range(rng.choice((0, 1, 5, 60, 400))))
        tree = token_counts.Tree(text, counter)
        assert tree.n_tokens == len(counter.encode(text))
        for _ in range(12):
            a = rng.randrange(-1, len(text) + 3)
            b = a + rng.choice((0, 0, 1, 2, 7, 500))
            new = "".join(rng.choice(bits) for _ in range(rng.choice((0, 1, 1, 3, 40))))
            tree.edit(a, b, new)
            lo = min(max(a, 0), len(text))
            text = text[:lo] + new + text[min(max(b, lo), len(text)) :]
            assert tree.text == text
            assert tree.n_tokens == len(counter.encode(text)), (turn, text)
            assert [s for b_ in tree.blocks for s in b_[1]] == list(map(len, counter.pattern.findall(text)))


def test_only_touched_regions_are_encoded(counter):
    tree = token_counts.Tree("some words here " * 20_000, counter)
    for k in range(50):
        tree.edit(5000 * k, 5000 * k + 3, "other")
    assert tree.encoded < 50 * 8 and tree.n_tokens == len(counter.encode(tree.text))


def test_long_texts_and_many_edits_take_linear_time(counter):
    began = time.time()
    assert token_counts.redactions("a" * 1_000_000) == [] and token_counts.redactions("a@" * 250_000) == []
    assert token_counts.redactions("1 " * 3 + "(" * 1_000_000) == [] and token_counts.redactions("a@b" + "-" * 1_000_000) == []
    text = "some words here " * 60_000 + "a" * 50_000
    tree = token_counts.Tree(text, counter)
    rng = random.Random(6)
    for k in range(10_000):
        at = rng.randrange(900_000)
        tree.edit(at, at + rng.randrange(9), rng.choice(("", "x", " new words", "1")))
    assert time.time() - began < 30
    assert tree.n_tokens == counter.total(tree.text)


def test_redactions_find_addresses_and_numbers():
    text = "mail a.b+c@x-y.org, or call +49 (30) 123-4567; not 12345, not a@b"
    assert [text[a:b] for a, b, _ in token_counts.redactions(text)] == ["+49 (30) 123-4567", "a.b+c@x-y.org"]


def test_dataframe_edits_and_odd_rows(spark, counter):
    docs = spark.createDataFrame([(1, "call me now"), (2, None), (3, ""), (None, "a b"), (1, "call me now"), (4, "x" * 200_000)], "doc_id long, text string").withColumn("edits", F.lit(1)).withColumn("of", F.lit(2))
    edits = spark.createDataFrame([(1, 2, 0, 3, "CALL"), (1, 1, 0, 4, "sms"), (None, 1, 1, 9, None), (3, 1, 0, 0, "new"), (4, 1, None, 3, "no"), (9, 1, 0, 1, "q")], "id long, seq long, start long, end long, new string")
    rows = token_counts.count_tokens(docs, PATH, PATTERN, edits).collect()
    assert sorted((str(r.id), r.text_after) for r in rows if r.id != 4) == [("1", "CALL me now")] * 2 + [("2", None), ("3", "new"), ("None", "a")]
    assert all(r.n_tokens_after == counter.total(r.text_after) for r in rows)
    assert token_counts.count_tokens(docs.limit(0), PATH, PATTERN).count() == 0


def test_query_equals_whole_encoding(spark, counter):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op3_token_counts(spark, sf).collect()
    assert len(rows) == len(texts) and any(r.n_edits for r in rows)
    for r in rows:
        after = texts[r.doc_id]
        for a, b, new in token_counts.redactions(after):
            after = after[:a] + new + after[b:]
        assert (r.n_tokens, r.n_tokens_after) == (counter.total(texts[r.doc_id]), counter.total(after))
