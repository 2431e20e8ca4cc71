import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from perigee.llm import lm


def kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)


class Tree:
    """Context-tree weighting as it is defined, one dictionary node at a time."""

    def __init__(self, depth):
        self.depth, self.n = depth, {}

    def steps(self, text):
        stream = b"\n" * self.depth + text
        for i in range(self.depth, len(stream)):
            node = 1
            for t in range(7, -1, -1):
                bit = stream[i] >> t & 1
                yield node, [stream[i - d : i] for d in range(self.depth + 1)], bit
                node = node * 2 + bit

    def learn(self, text):
        for node, contexts, bit in self.steps(text):
            for c in contexts:
                self.n.setdefault((node, c), [0, 0])[bit] += 1

    def weigh(self):
        self.w, self.kids = {}, {}
        for node, c in self.n:
            if c:
                self.kids.setdefault((node, c[1:]), []).append((node, c))
        self.below = {}
        for key in sorted(self.n, key=lambda k: -len(k[1])):
            own = kt(*self.n[key])
            if len(key[1]) == self.depth:
                self.w[key] = own
            else:
                self.below[key] = sum(self.w[k] for k in self.kids[key])
                self.w[key] = math.log(0.5) + np.logaddexp(own, self.below[key])

    def score(self, text):
        total = 0
        for node, contexts, bit in self.steps(text):
            p = 0.5
            for c in reversed(contexts):
                n = self.n.get((node, c), [0, 0])
                own = (n[bit] + 0.5) / (sum(n) + 1)
                if len(c) == self.depth:
                    p = own
                else:
                    ratio = math.exp(kt(*n) - self.below.get((node, c), 0.0))
                    p = (ratio * own + p) / (ratio + 1)
            total += math.log10(p)
        return total


def lower(t):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode())


@pytest.mark.parametrize(("depth", "bucket", "chunk"), [(3, 10**7, 10**6), (4, 300, 50), (2, 2000, 200)])
def test_scores_match_brute_force(spark, monkeypatch, depth, bucket, chunk):
    monkeypatch.setattr(lm, "CHUNK", chunk)
    monkeypatch.setattr(lm.log_probabilities, "__defaults__", (400_000 if depth == 2 else 90,))
    rng = random.Random(depth)
    rows = [(d, " ".join(rng.choice(("the", "The", "of", "ß", "Éa", "x9", "in\tto", "q" * 70)) for _ in range(rng.randrange(30)))) for d in range(40)]
    rows += [(100, None), (101, ""), (102, " \n\x0b"), (None, "the of"), (3, "the of the"), (3, "the of the")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("seq", F.lit(1)).withColumn("id", F.lit("x")).repartition(3)
    got = lm.score(df, depth=depth, bucket=bucket, broadcast=0 if depth == 4 else 10**6).collect()
    assert len(got) == len(rows)
    held = lambda d: None if d is None else zlib.crc32(str(d).encode()) % 7 == 2
    words, docs, tree = Counter(), 0, Tree(depth)
    for d, t in rows:
        if held(d) is False:
            words.update(lower(t).split())
            docs += 1
            tree.learn(b" ".join(lower(t).split()) + b"\n")
    tree.weigh()
    total, distinct = sum(words.values()) + docs, len(words) + 1
    want = []
    for d, t in rows:
        w = lower(t).split()
        base = sum(math.log10((words[x] + 1) / (total + distinct + 1)) for x in w) + math.log10((docs + 1) / (total + distinct + 1))
        want.append((str(d), held(d), len(w) + 1, sum(x in words for x in w) + 1, total, base, tree.score(b" ".join(w) + b"\n")))
    for a, b in zip(sorted(((str(r.id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=str), sorted(want, key=str), strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-8 and abs(a[6] - b[6]) < 1e-6
    assert any(r.held_out for r in got)


def test_bytes_after_a_context_sum_to_one(spark):
    counts = [((c2 << 16 | c1 << 8 | s), n) for c2, c1, s, n in ((97, 98, 99, 5), (97, 98, 100, 1), (98, 98, 99, 2))]
    every = {k: n for k, n in counts} | {97 << 16 | 98 << 8 | s: 0 for s in range(256) if s not in (99, 100)}
    rows = lm.log_probabilities(spark.createDataFrame(list(every.items()), "key long, n long"), 2).collect()
    assert abs(sum(10**r.logp for r in rows if r.key >> 8 == 97 << 8 | 98) - 1) < 1e-9


def test_better_than_words_on_held_out_texts(spark):
    rows = [r for r in lm.score(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_empty_table(spark):
    assert lm.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert lm.score(spark.createDataFrame([(9, "a b")], "doc_id long, text string"), mod=1, rest=0).first().n_known == 0
