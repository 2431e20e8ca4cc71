import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from perigee.llm import quality
from perigee.llm.queries import op8_quality

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = op8_quality(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.95
    clean = [r.predicted for r in held if labels[r.doc_id] == 1]
    assert np.mean(clean) > 0.98


def test_training_ignores_held_out_labels_and_row_order(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    a = quality.train(docs, labels)
    turned = labels.withColumn("quality", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    b = quality.train(docs.repartition(5), turned.repartition(3))
    assert a.bias == b.bias and (a.weights == b.weights).all()
    c = quality.train(docs, labels, held_bytes=0)
    assert a.bias == c.bias and (a.weights == c.weights).all()


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, " \n ", "x"), (None, "good words", "x"), (4, "a\n" * 300_000, "x"), (4, "good words", "x")], "doc_id long, text string, _y string")
    labels = spark.createDataFrame([(2, 1), (3, None), (4, 7), (None, 1), (6, 0)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    rows = quality.score(docs, model, keep=("doc_id",)).collect()
    assert len(rows) == 6 and all(0 <= r._score <= 1 for r in rows)
    none = quality.train(docs, labels.limit(0))
    assert {r._score for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.score(docs.limit(0), none).count() == 0


def test_long_text_equals_its_whole(spark, monkeypatch):
    h, text = quality.Hasher(), " ".join(f"w{i % 97} !!" for i in range(5000))
    whole = h.features(text, 18)
    monkeypatch.setattr(quality, "CHUNK", 313)
    part = h.features(text, 18)
    assert (whole[0] == part[0]).all() and np.allclose(whole[1], part[1])


def plain_features(text):
    """{index: value} by dictionaries: words and runs of marks, their shapes, pairs of both, repeats."""
    words = re.findall(r"[^\W_]+|(?:[^\w\s]|_)+", text or "")
    code = lambda w: zlib.crc32(w.encode())
    shape = lambda w: w[:4] if not w[0].isalnum() else "0" if w.isdigit() else "A" if w.isupper() and len(w) > 1 else "Aa" if w[0].isupper() else "a"
    own, shapes = [code(w) for w in words], [code(f"shape {shape(w)}") for w in words]
    found = [*own, *shapes]
    found += [(a * 0x9E3779B1 % 2**32) ^ ((b + (a >> 15)) % 2**32) for a, b in zip(own, own[1:])]
    found += [(a * 0x9E3779B1 % 2**32) ^ ((b + 0x85EBCA77) % 2**32) for a, b in zip(shapes, shapes[1:])]
    found += [0xC2B2AE3D for a, b in zip(own, own[1:]) if a == b]
    counts = Counter(x * 0x85EBCA77 % 2**32 >> 14 for x in found)
    values = {i: 1 + math.log(n) for i, n in counts.items()}
    norm = math.sqrt(sum(v * v for v in values.values()))
    return {i: v / norm for i, v in values.items()}


def test_scores_match_a_plain_learner(spark):
    """Follow-the-regularised-leader entry by entry, in dictionaries, over the same rows in the same order."""
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.quality in (0, 1) and zlib.crc32(str(r.doc_id).encode()) % 5}
    order = [r.id for r in spark.createDataFrame([(str(i),) for i in labels if i in texts], "id string").orderBy(F.xxhash64("id"), "id").collect()]
    rows = [({i: float(np.float32(v)) for i, v in plain_features(texts[int(d)]).items()}, labels[int(d)]) for d in order]
    z, n, zb, nb, (alpha, beta, l1, l2) = {}, {}, 0.0, 0.0, (1.0, 1.0, 0.02, 0.1)
    weight = lambda i: 0.0 if abs(z.get(i, 0.0)) <= l1 else (math.copysign(l1, z[i]) - z[i]) / ((beta + math.sqrt(n[i])) / alpha + l2)
    bias = lambda: -zb * alpha / (beta + math.sqrt(nb))
    for _ in range(6):
        for x, y in rows:
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-(sum(w[i] * v for i, v in x.items()) + bias())))
            old = bias()
            for i, v in x.items():
                g = (p - y) * v
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / alpha * w[i]
                n[i] = n.get(i, 0.0) + g * g
            zb += (p - y) - (math.sqrt(nb + (p - y) ** 2) - math.sqrt(nb)) / alpha * old
            nb += (p - y) ** 2
    final, last = {i: weight(i) for i in z}, bias()
    for r in op8_quality(spark, sf).collect():
        s = last + sum(final.get(i, 0.0) * v for i, v in plain_features(texts[r.doc_id]).items())
        assert abs(r.score - 1 / (1 + math.exp(-max(-35.0, min(35.0, s))))) < 1e-9
