"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader updates.

Features of a text: hashed words and word pairs (words are runs of letters or digits, and runs of other marks,
case kept), each also as a shape (letters' case, digits, the marks themselves), plus pairs that repeat their word;
an entry's weight is 1 + log(count), and the vector has length one. Training takes labelled rows only, at most
`sample` of them, picked by a hash of the id; their sparse vectors, not their texts, come to the driver, which holds
them only up to a bound in bytes. Scoring
is a sparse dot product per text, in Arrow batches, with the weights (2^bits doubles) sent along.

Defined results: a null or empty text, or one without words, has the bias alone as its score; a null id is
scored and never trained on, held_out null; rows without a label are not trained on, repeated rows are scored
alike, other columns are ignored. Without any labelled rows all scores are 0.5.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perigee.llm.common import held_out, materialize

Row = tuple[np.ndarray, np.ndarray, int]
BITS = 18
#: Labelled rows that training uses at most.
SAMPLE = 12_000
#: Features that the driver holds at most; beyond, each epoch reads them again.
HELD_BYTES = 256 << 20
#: Words that are mixed at a time, so that a long text needs no long arrays.
CHUNK = 200_000
_PAIR, _SHAPE, _REPEAT = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)


def _words() -> Callable[[str], list[str]]:
    import re

    return re.compile(r"[^\W_]+|(?:[^\w\s]|_)+").findall


class Hasher:
    """Hash and shape hash of words; both are kept, and the cache is emptied when full."""

    def __init__(self):
        self.find, self.cache = _words(), {}

    def of(self, words: list[str]) -> np.ndarray:
        cache = self.cache
        if len(cache) > 300_000:
            cache.clear()
        out = []
        for w in words:
            h = cache.get(w)
            if h is None:
                if w[0].isalnum():
                    shape = "0" if w.isdigit() else "A" if w.isupper() and len(w) > 1 else "Aa" if w[0].isupper() else "a"
                else:
                    shape = w[:4]
                h = cache[w] = crc32(w.encode()) | crc32(f"shape {shape}".encode()) << 32
            out.append(h)
        return np.array(out, dtype=np.uint64)

    def features(self, text: str | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Indices in order and their values; the vector has length one, or is empty."""
        words = self.find(text or "")
        index, total = np.zeros(0, np.uint32), np.zeros(0)
        last = np.zeros(0, np.uint64)
        for at in range(0, len(words), CHUNK):
            both = np.concatenate([last, self.of(words[at : at + CHUNK])])
            word, shape = both.astype(np.uint32), (both >> np.uint64(32)).astype(np.uint32)
            new = len(last)
            pairs = word[:-1] * _PAIR ^ word[1:] + (word[:-1] >> np.uint32(15))
            shapes = shape[:-1] * _PAIR ^ shape[1:] + _SHAPE
            same = np.full(int((word[:-1] == word[1:]).sum()), _REPEAT)
            found, n = np.unique(np.concatenate([word[new:], shape[new:], pairs, shapes, same]) * _SHAPE >> np.uint32(32 - bits), return_counts=True)
            if at == 0:
                index, total = found, n.astype(float)
            else:
                index, where = np.unique(np.concatenate([index, found]), return_inverse=True)
                total = np.bincount(where, np.concatenate([total, n]))
            last = both[-1:]
        value = 1 + np.log(total)
        return index.astype(np.int32), value / math.sqrt(float(value @ value)) if len(value) else value


class Model:
    """Weights and bias; picklable, sent to the workers as it is."""

    def __init__(self, weights: np.ndarray, bias: float, bits: int):
        self.weights, self.bias, self.bits = weights, bias, bits

    def score(self, hasher: Hasher, text: str | None) -> float:
        i, x = hasher.features(text, self.bits)
        z = self.bias + float(self.weights[i] @ x)
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, z))))


def ftrl(rows: Callable[[], Iterable[Row]], bits: int = BITS, epochs: int = 6, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1) -> Model:
    """Follow-the-regularised-leader with per-coordinate rates (McMahan et al., 2013); `rows` gives the rows (indices,
    values, label) anew, in one order, for each epoch."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    zb = nb = 0.0
    for _ in range(epochs):
        for i, x, y in rows():
            zi, ni = z[i], n[i]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + root) / alpha + l2))
            wb = -zb * alpha / (beta + math.sqrt(nb))
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, float(w @ x) + wb))))
            g = (p - y) * x
            z[i] = zi + g - (np.sqrt(ni + g * g) - root) / alpha * w
            n[i] = ni + g * g
            gb = p - y
            zb += gb - (math.sqrt(nb + gb * gb) - math.sqrt(nb)) / alpha * wb
            nb += gb * gb
    weights = np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))
    return Model(weights, -zb * alpha / (beta + math.sqrt(nb)), bits)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", folds: int = 5, sample: int = SAMPLE, bits: int = BITS, held_bytes: int = HELD_BYTES) -> Model:
    """Learns from labelled rows whose crc32(id as text) mod `folds` is not 0, at most `sample` of them (those whose
    ids hash lowest). A label that is neither 0 nor 1 counts as none; of several labels of an id the largest holds.
    Features of up to `held_bytes` stay on the driver through all epochs; more are read anew from the shared folder for
    each one, with the same result.
    """
    known = labels.where(F.col(label).isin(0, 1) & (held_out(F.col(id_col), folds) != 0)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label).alias("_y"))
    known = known.orderBy(F.xxhash64(F.col("_id").cast("string")), "_id").limit(sample)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).join(F.broadcast(known), "_id")  # `sample` rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                made = [hasher.features(t.as_py(), bits) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.string()), part.column(2).cast(pa.int32()), pa.array([i.tobytes() for i, _ in made], pa.binary()), pa.array([x.astype(np.float32).tobytes() for _, x in made], pa.binary())], names=["id", "y", "i", "x"])

    # Repeated rows of an id count once: the sample's bound holds for what is gathered.
    found = rows.select("_id", "_text", "_y").mapInArrow(run, "id string, y int, i binary, x binary").groupBy("id").agg(F.min_by(F.struct("y", "i", "x"), F.xxhash64("i", "x")).alias("r"))
    found = materialize(found)

    def read() -> Iterator[Row]:
        """The rows in the order of their ids' hashes, a partition at a time."""
        for r in found.orderBy(F.xxhash64("id"), "id").toLocalIterator():
            yield np.frombuffer(r.r.i, np.int32), np.frombuffer(r.r.x, np.float32).astype(float), r.r.y

    size = found.agg(F.sum(F.octet_length("r.i") * 3)).first()[0] or 0
    if size > held_bytes:
        return ftrl(read, bits)
    data = list(read())
    return ftrl(lambda: data, bits)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, score) of every row, or the columns `keep` with a column _score."""
    names = list(keep) or [id_col]
    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField("_score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            scores = pa.array([model.score(hasher, t.as_py()) for t in batch.column(0)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], scores], names=[f.name for f in schema])

    return docs.select(F.col(text_col).cast("string").alias("_text"), *names).mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of docs whose texts score at least `threshold`, as they are."""
    rows = docs.select(F.col(text_col).alias("_text"), F.struct("*").alias("row"))
    return score(rows, model, text_col="_text", keep=("row",)).where(F.col("_score") >= threshold).select("row.*")
