"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last return the
columns of documents. Between stages the rows are written to the folder that the cluster names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perigee.llm import decontaminate, lines, packing, quality, simhash
from perigee.llm.common import materialize, small_batches, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Trains on the labels of docs and keeps the documents that score at least 0.3.

    Rows go or stay one by one, each by its own text, with all columns as they were: repeated rows alike, a null or empty
    text by the bias alone, a null id like any other (it is never trained on). Without labels every row scores 0.5 and
    stays. A column of any name passes through.
    """
    small_batches(spark)
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")), 0.3)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated and nearly repeated lines out of the texts; every document stays, n_chars follows its text.

    Of equal or near lines the earliest stays, by (doc_id, line number), a null id before all others; rows that share an id
    share their places, so repeated rows keep the same lines. A null text stays null; a text all of whose lines go is empty.
    """
    return lines.dedup_lines(docs, count_col="n_chars")


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more) stays, that with the smallest id.

    Null ids come last; of rows that share an id, the one whose text hashes lowest stays; of equal rows, one. Null and empty
    texts, and those without words, are one group. The row that stays is as it was.
    """
    small_batches(spark)
    return simhash.keep_one(docs, size=5, similarity=0.8)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item is found go.

    Each row is judged by its own text, whatever ids it shares; a null or empty text contains nothing and stays; an item
    without tokens is never found; an empty benchmark takes nothing.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences.

    Every row is a document of its own, repeated rows and null ids too; a null or empty text is its end token alone. An
    empty table gives no pieces.
    """
    small_batches(spark)
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("simhash near-dedup", simhash_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", sequence_packing),
]

#: SQL can express neither the trained classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
