"""Language-model scoring by context-tree weighting over bytes, with an add-one word model as its base line.

A text is its words (runs without ASCII white space, A-Z lower-cased), one blank between them and an end mark; so the
byte string and the token sequence stand for each other. Each byte is eight binary decisions. A decision's context tree
(one for each prefix of the byte's bits) branches by the bytes before it, nearest first, `depth` of them. A node has the
Krichevsky-Trofimov estimate of its decisions in the training texts and, unless it is a leaf, weighs it half against the
product of its children (Willems et al., 1995); a decision's probability mixes the estimates of all depths along its
path with the weights that training leaves. The trees stay as trained while texts are scored, so a text's score
depends neither on other scored texts nor on any order.

How it is spread: texts are packed into buckets of some megabytes, one compressed row each. A bucket counts its
distinct words and a partition its distinct (depth + 1)-grams; their training counts are added up by key. Trees are
built in groups of contexts that agree in their three nearest bytes (a group has some hundred thousand grams, a single
context at most what two more bytes and a symbol can make); the level above from sums by key over all groups, the two top
levels (256 x 255 + 255 rows at most, which reach the driver) from sums over that. Each distinct gram then has one log probability. They are counted: up to BROADCAST of them go to
every worker; more go, by a join, to the buckets that hold the gram, with the same scores. Word counts go back to
their buckets where they differ from what the bucket has counted itself.

Defined results: a null text counts as empty and is an end mark alone; a null id is scored and never trained on, its
held_out null; repeated rows are separate texts; other columns are ignored. Words are told apart by 64-bit hashes
while they are counted (a clash would add two words' counts).
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from perigee.llm.common import held_out, materialize
from perigee.llm.simhash import LOWER

DEPTH = 5
#: Distinct grams whose log probabilities, 16 bytes each, are broadcast; where there are more, each bucket gets its own.
BROADCAST = 4_000_000
#: Bytes of text in a bucket, about.
BUCKET = 6_000_000
#: Grams in a group of contexts, about, while trees are built.
GROUP = 400_000
#: Positions that are worked on at a time.
CHUNK = 1_000_000
END = b"\n"
GRAM, WORD = 0, 1


def lgamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x > 0, by Stirling's series eight further on."""
    y = x + 8
    shift = np.log(x) + np.log(x + 1) + np.log(x + 2) + np.log(x + 3) + np.log(x + 4) + np.log(x + 5) + np.log(x + 6) + np.log(x + 7)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def estimate(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov block probability."""
    return lgamma(n0 + 0.5) + lgamma(n1 + 0.5) - lgamma(n0 + n1 + 1.0) - math.log(math.pi)


def grams(stream: np.ndarray, depth: int) -> np.ndarray:
    """Keys of all positions from `depth` on: the byte, then the bytes before it, each eight bits higher."""
    key = stream[depth:].astype(np.int64)
    for k in range(1, depth + 1):
        key |= stream[depth - k : len(stream) - k].astype(np.int64) << (8 * k)
    return key


def _chunks(seqs: list[bytes], depth: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, last, keys, where each text's keys begin), for runs of texts; a text longer than a chunk comes in parts."""
    pad, at = END * depth, 0
    while at < len(seqs):
        to, size = at, 0
        while to < len(seqs) and (to == at or size + len(seqs[to]) <= CHUNK):
            size += len(seqs[to])
            to += 1
        if size > CHUNK:
            whole = np.frombuffer(pad + seqs[at], dtype=np.uint8)
            for part in range(0, size, CHUNK):
                yield at, to, grams(whole[part : part + CHUNK + depth], depth), np.zeros(1, dtype=np.int64)
        else:
            stream = np.frombuffer(b"".join(chain.from_iterable((pad, s) for s in seqs[at:to])), dtype=np.uint8)
            keys = grams(stream, depth)
            lengths = np.array([len(s) for s in seqs[at:to]], dtype=np.int64)
            starts = np.cumsum(lengths) - lengths
            # Between two texts stand `depth` pad bytes, which are no text.
            take = np.ones(len(keys), dtype=bool)
            gaps = (np.cumsum(lengths + depth) - depth)[:-1]
            take[(gaps[:, None] + np.arange(depth)).ravel()] = False
            yield at, to, keys[take], starts
        at = to


def packed(docs: DataFrame, mod: int, rest: int, id_col: str, text_col: str, bucket: int) -> DataFrame:
    """(bucket, blob): each row some megabytes of texts, as a compressed Arrow stream of (id, held_out, seq)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k, held, size = TaskContext.get().partitionId(), 0, [], 0

        def close() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            whole = pa.Table.from_batches(held)
            with pa.ipc.new_stream(sink, whole.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(whole)
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | k], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["bucket", "blob"])

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                seqs = [b" ".join((t.as_py() or b"").translate(LOWER).split()) + END for t in some.column(2).cast(pa.binary())]
                held.append(pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(seqs, pa.large_binary())], names=["id", "held_out", "seq"]))
                size += sum(map(len, seqs))
                if size >= bucket:
                    yield close()
                    held, size, k = [], 0, k + 1
        if held:
            yield close()

    rows = docs.select(F.col(id_col).alias("id"), (held_out(F.col(id_col), mod) == rest).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "bucket long, blob binary")


def _opened(blob: bytes) -> tuple[pa.Table, list[bytes], np.ndarray]:
    texts = pa.ipc.open_stream(blob).read_all()
    return texts, texts.column("seq").to_pylist(), np.array([h is False for h in texts.column("held_out").to_pylist()], dtype=bool)


def _words(seqs: list[bytes], train: np.ndarray) -> tuple[dict[bytes, int], np.ndarray, np.ndarray]:
    """Distinct words with their numbers, their hashes, their counts in the training texts."""
    from xxhash import xxh64_intdigest

    number: dict[bytes, int] = {}
    counts = np.zeros(1024, dtype=np.int64)
    for seq, own in zip(seqs, train.tolist(), strict=True):
        words = seq.split()
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
        if len(number) > len(counts):
            counts = np.concatenate([counts, np.zeros(max(len(counts), len(number) - len(counts)), dtype=np.int64)])
        if own:
            np.add.at(counts, ids, 1)
    hashes = np.fromiter((xxh64_intdigest(w) for w in number), dtype=np.uint64, count=len(number)).view(np.int64)
    return number, hashes, counts[: len(number)]


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(where, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def _grams_of(seqs: list[bytes], train: list[bool], depth: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """`parts` and the distinct grams of the texts with their counts in training texts, merged now and then."""
    for learn in (True, False):
        for _, _, keys, _ in _chunks([s for s, t in zip(seqs, train, strict=True) if t == learn], depth):
            found, n = np.unique(keys, return_counts=True)
            parts.append((found, n if learn else np.zeros(len(n), dtype=np.int64)))
            if len(parts) == 4:
                parts = [_merged(parts)]
    return parts


def _rows(bucket: int, kind: int, keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(keys), 100_000):
        size = len(keys[at : at + 100_000])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(size, bucket)), pa.array(np.full(size, kind, dtype=np.int8)), pa.array(keys[at : at + size]), pa.array(n[at : at + size])], names=["bucket", "kind", "key", "n"])


def counted(texts: DataFrame, depth: int) -> DataFrame:
    """(bucket, kind, key, n): each bucket's distinct words and each partition's distinct grams (bucket -1), n of them
    in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                _, seqs, train = _opened(blob.as_py())
                _, hashes, counts = _words(seqs, train)
                yield from _rows(bucket, WORD, hashes, counts)
                parts = _grams_of(seqs, train.tolist(), depth, parts)
        if parts:
            yield from _rows(-1, GRAM, *_merged(parts))

    return texts.mapInArrow(run, "bucket long, kind byte, key long, n long")


def held_grams(texts: DataFrame, depth: int) -> DataFrame:
    """(bucket, key): each bucket's distinct grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                _, seqs, train = _opened(blob.as_py())
                for rows in _rows(bucket, GRAM, *_merged(_grams_of(seqs, train.tolist(), depth, []))):
                    yield rows.select(["bucket", "key"])

    return texts.mapInArrow(run, "bucket long, key long")


def _run_ids(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each distinct id, and one place that has it."""
    _, first, where = np.unique(ids, return_index=True, return_inverse=True)
    return where, first


def _decisions(keys: np.ndarray, n: np.ndarray, depth: int, low: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each of the byte's eight decisions, of grams that agree in the `low` nearest context bytes: its number, the
    grams' bits, the level-`low` node of each gram, a place of each node, its counts of zeros and ones, the log of its
    weighted probability; and, last, the probability that each gram's bit has from level `low` down."""
    symbol, context = keys & 255, keys >> 8
    for t in range(8):
        bit = (symbol >> (7 - t)) & 1
        node = (1 << t) | symbol >> (8 - t)
        weighted = first = None
        chain_: list[tuple[np.ndarray, np.ndarray | None]] = []
        for level in range(depth, low - 1, -1):
            mask = (1 << (8 * level)) - 1
            where, place = _run_ids((context & mask) << 8 | node)
            n1 = np.bincount(where, n * bit)
            n0 = np.bincount(where, n * (1 - bit))
            own = estimate(n0, n1)
            kt = np.where(bit == 1, n1[where] + 0.5, n0[where] + 0.5) / ((n0 + n1)[where] + 1.0)
            if level == depth:
                ratio, logw = None, own
            else:
                below = np.bincount(where[first], weighted, len(place))
                ratio, logw = np.exp(np.clip(own - below, -700, 700)), math.log(0.5) + np.logaddexp(own, below)
            chain_.append((kt, None if ratio is None else ratio[where]))
            weighted, first = logw, place
        p = chain_[0][0]
        for kt, ratio in chain_[1:]:
            p = (ratio * kt + p) / (ratio + 1)
        yield t, bit, where, place, np.stack([n0, n1]), weighted, p


def log_probabilities(counts: DataFrame, depth: int, rows: int = GROUP) -> DataFrame:
    """(key, logp): log10 of the probability of each gram's byte after the bytes before it. counts: (key, n).

    Grams that agree in their `low` nearest context bytes meet in one group, some `rows` of them with others; the level
    above is summed up by key and goes back to the groups that lie below it, the two top levels go to all."""
    low = min(3, depth)
    groups = max(1, -(-counts.count() // rows))
    near = lambda k: F.shiftright("key", 8).bitwiseAND(F.lit((1 << 8 * k) - 1))
    grams_ = counts.withColumn("grp", F.pmod(F.xxhash64(near(low)), F.lit(groups)).cast("int"))

    def lowest(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, n, out = pdf["key"].to_numpy(), pdf["n"].to_numpy().astype(float), []
        for t, _, _, place, n01, weighted, _ in _decisions(keys, n, depth, low):
            symbol = keys[place] & 255
            out.append(pd.DataFrame({"context": (keys[place] >> 8) & ((1 << 8 * low) - 1), "node": (1 << t) | symbol >> (8 - t), "n0": n01[0], "n1": n01[1], "w": weighted}))
        return pd.concat(out)

    def weighed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Nodes with the sums of their children's weights as `below`: their own weight, and how it weighs against them."""
        for pdf in batches:
            own, below = estimate(pdf["n0"].to_numpy(), pdf["n1"].to_numpy()), pdf["below"].to_numpy()
            yield pdf[["context", "node", "n0", "n1"]].assign(w=math.log(0.5) + np.logaddexp(own, below), ratio=np.exp(np.clip(own - below, -700, 700)))

    summed = lambda nodes, k: nodes.groupBy(F.col("context").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("context"), "node").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("w").alias("below"))
    nodes = grams_.groupBy("grp").applyInPandas(lowest, "context long, node long, n0 double, n1 double, w double")
    middle = None
    if low == 3:
        middle = nodes = materialize(summed(nodes, 2).mapInPandas(weighed, "context long, node long, n0 double, n1 double, w double, ratio double"))
    top = summed(nodes, 1).toPandas()  # 256 x 255 rows at most
    n0, n1, below = (np.zeros((257, 256)) for _ in range(3))
    one, node = top["context"].to_numpy(), top["node"].to_numpy()
    n0[one, node], n1[one, node], below[one, node] = top["n0"], top["n1"], top["below"]
    own = estimate(n0[:256], n1[:256])
    weighted = math.log(0.5) + np.logaddexp(own, below[:256])
    ratio = np.zeros((257, 256))
    ratio[:256] = np.exp(np.clip(own - below[:256], -700, 700))
    # Row 256: the root of each decision.
    present = np.zeros((256, 256), dtype=bool)
    present[one, node] = True
    n0[256], n1[256], sums = n0[:256].sum(axis=0), n1[:256].sum(axis=0), np.where(present, weighted, 0).sum(axis=0)
    ratio[256] = np.exp(np.clip(estimate(n0[256], n1[256]) - sums, -700, 700))

    def finish(pdf: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        keys, n = pdf["key"].to_numpy(), pdf["n"].to_numpy().astype(float)
        total, symbol, first = np.zeros(len(keys)), keys & 255, (keys >> 8) & 255
        two = ((keys >> 8) & 65_535) << 8
        name = (above["context"].to_numpy() << 8) | above["node"].to_numpy()
        order = np.argsort(name)
        name, m0, m1, mr = name[order], *(above[c].to_numpy()[order] for c in ("n0", "n1", "ratio"))
        for t, bit, _, _, _, _, p in _decisions(keys, n, depth, low):
            at = (1 << t) | symbol >> (8 - t)
            if len(name):
                k = np.searchsorted(name, two | at)
                kt = (np.where(bit == 1, m1[k], m0[k]) + 0.5) / (m0[k] + m1[k] + 1.0)
                p = (mr[k] * kt + p) / (mr[k] + 1)
            for row in (first, np.full(len(keys), 256)):
                kt = (np.where(bit == 1, n1[row, at], n0[row, at]) + 0.5) / (n0[row, at] + n1[row, at] + 1.0)
                p = (ratio[row, at] * kt + p) / (ratio[row, at] + 1)
            total += np.log10(p)
        return pd.DataFrame({"key": keys, "logp": total})

    if middle is None:
        none = pd.DataFrame({"context": np.zeros(0, np.int64), "node": np.zeros(0, np.int64), "n0": [], "n1": [], "ratio": []})
        return grams_.groupBy("grp").applyInPandas(lambda pdf: finish(pdf, none), "key long, logp double")
    lies = materialize(grams_.select("grp", near(2).alias("context")).distinct())
    back = middle.join(lies, "context").select("grp", "context", "node", "n0", "n1", "ratio")
    return grams_.groupBy("grp").cogroup(back.groupBy("grp")).applyInPandas(finish, "key long, logp double")


_held: dict[str, tuple[pd.Index, np.ndarray]] = {}


def _held_once(token: str, small) -> tuple[pd.Index, np.ndarray]:
    """The broadcast model with an index of its keys, once for a worker's process."""
    if token not in _held:
        _held.clear()
        keys, logp = small.value
        _held[token] = pd.Index(keys), logp
    return _held[token]


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mod: int = 7, rest: int = 2, depth: int = DEPTH, bucket: int = BUCKET, broadcast: int = BROADCAST) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte) of every row. Rows
    whose crc32(id as text) mod `mod` is `rest` are held out of training. depth: 2 to 6."""
    texts = materialize(packed(docs, mod, rest, id_col, text_col, bucket))
    stats = materialize(counted(texts, depth).where("key is not null"))
    model = materialize(log_probabilities(materialize(stats.where(F.col("kind") == GRAM).groupBy("key").agg(F.sum("n").alias("n"))), depth))
    words = stats.where(F.col("kind") == WORD).select("bucket", "key", "n").repartition("key")
    # owner: one of the buckets in which a word is known, so that it counts once.
    totals = words.groupBy("key").agg(F.sum("n").alias("total"), F.min(F.when(F.col("n") > 0, F.col("bucket"))).alias("owner"))
    seen = Observation()
    known = words.join(totals, "key").observe(seen, F.sum((F.col("owner") == F.col("bucket")).cast("long")).alias("words"), F.sum("n").alias("tokens"))
    known = materialize(known.where("total <> n").select("bucket", F.lit(WORD).cast("byte").alias("kind"), "key", F.col("total").cast("double").alias("value")))
    n_train = docs.where(held_out(F.col(id_col), mod) != rest).count()
    distinct = (seen.get["words"] or 0) + (n_train > 0)
    tokens = (seen.get["tokens"] or 0) + n_train
    least = math.log10(tokens + distinct + 1)
    kind = docs.schema[id_col].dataType.simpleString()

    small, spread, token = None, known.limit(0), uuid.uuid4().hex
    if model.count() <= broadcast:
        every = model.toArrow()
        small = docs.sparkSession.sparkContext.broadcast((every.column("key").to_numpy(), every.column("logp").to_numpy()))
    else:
        spread = held_grams(texts, depth).join(model, "key").select("bucket", F.lit(GRAM).cast("byte").alias("kind"), "key", F.col("logp").alias("value"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        outs = []
        of, keys, values = (right.column(c).to_numpy() for c in ("kind", "key", "value"))
        if small is None:
            gram, logp = pd.Index(keys[of == GRAM]), values[of == GRAM]
        else:
            gram, logp = _held_once(token, small)
        word, total = pd.Index(keys[of == WORD]), values[of == WORD]
        for blob in left.column("blob"):
            rows, seqs, train = _opened(blob.as_py())
            number, hashes, counts = _words(seqs, train)
            if len(word):
                at = word.get_indexer(hashes)
                counts = np.where(at >= 0, total[at].astype(np.int64), counts)
            share, there = np.log10(counts + 1.0), counts > 0
            n, n_known, base, lm = (np.zeros(len(seqs), dtype=k) for k in (np.int64, np.int64, float, float))
            for k, seq in enumerate(seqs):
                own = seq.split()
                ids = np.fromiter(map(number.__getitem__, own), dtype=np.int64, count=len(own))
                n[k] = len(own) + 1
                n_known[k] = there[ids].sum() + (n_train > 0)
                base[k] = share[ids].sum() + math.log10(n_train + 1) - n[k] * least
            for a, b, found, starts in _chunks(seqs, depth):
                lm[a:b] += np.add.reduceat(logp[gram.get_indexer(found)], starts)
            size = np.array([len(s) for s in seqs], dtype=np.int64)
            outs.append(pa.table({"id": rows.column("id"), "held_out": rows.column("held_out"), "n_tokens": n, "n_known": n_known, "train_tokens": np.full(len(n), tokens), "base_score": base, "score": lm, "n_bytes": size, "bits_per_byte": -lm / math.log10(2) / size}))
        return pa.concat_tables(outs)

    back = spread.unionByName(known)
    return texts.groupBy("bucket").cogroup(back.groupBy("bucket")).applyInArrow(run, f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double")
