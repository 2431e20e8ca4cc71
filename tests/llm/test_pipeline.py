"""The stages against brute-force versions of them, each on what the stage before it really kept."""

import sys

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from perigee.llm import quality

sys.path.insert(0, __file__.rpartition("/")[0])
import test_decontaminate  # noqa: E402
import test_lines  # noqa: E402
import test_simhash  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    now = {r.doc_id: r.text for r in docs.collect()}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hasher, rows = quality.Hasher(), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.columns == columns
        rows = {r.doc_id: r for r in docs.collect()}
        if name == "quality classifier":
            want = {d: t for d, t in now.items() if model.score(hasher, t) >= 0.3}
            assert 0 < len(want) < len(now)
        elif name == "line dedup":
            gone = test_lines.brute(sorted(now.items()))
            want = {d: "\n".join(x for n, x in enumerate(t.split("\n")) if (d, n) not in gone) for d, t in now.items()}
            assert all(r.n_chars == len(r.text) for r in rows.values() if r.text != now[r.doc_id])
        elif name == "simhash near-dedup":
            ids = sorted(now)
            root = test_simhash.slow_similar([test_simhash.slow_shingles(now[i]) for i in ids])
            want = {ids[k]: now[ids[k]] for k in range(len(ids)) if root[k] == k}
        else:
            found = {d for d, _ in test_decontaminate.brute(now.items(), bench)}
            want = {d: t for d, t in now.items() if d not in found}
        assert {d: r.text for d, r in rows.items()} == want, name
        now = want
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    n = {d: len(tok.encode(t, add_special_tokens=False).ids) + 1 for d, t in now.items()}
    assert {p.doc_id: p.doc_tokens for p in pieces} == n
    at = sorted((p.sequence_id * 4096 + p.offset, p.length) for p in pieces)
    assert [a for a, _ in at] == np.cumsum([0, *(x for _, x in at)])[:-1].tolist() and sum(x for _, x in at) == sum(n.values())


def test_run_equals_its_stages_and_odd_rows(spark):
    run = corpus_pipeline.run(spark, SF)
    assert run.count() > 0 and run.agg(F.sum("length")).first()[0] == run.groupBy("doc_id").agg(F.max("doc_tokens").alias("n")).agg(F.sum("n")).first()[0]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(3).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.lit(None).cast("long"))
    for some in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            some = spark.createDataFrame((out := stage(spark, some, SF)).collect(), out.schema)


def test_stages_bound_the_batches_of_long_texts(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ten bytes "), 1000).alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64())], names=["n"])

    few = spark.read.parquet(f"{SF}/documents.parquet").limit(3)
    try:
        for _, stage in (corpus_pipeline.STAGES[k] for k in (0, 2, 4)):
            spark.conf.unset(key)
            stage(spark, few, SF)
            found = [r.n for r in docs.mapInArrow(sizes, "n long").collect()]
            assert sum(found) > 30_000_000 and max(found) < 9_000_000
        spark.conf.set(key, "16m")
        corpus_pipeline.sequence_packing(spark, few, SF)
        assert spark.conf.get(key) == "16m"
    finally:
        spark.conf.unset(key)
