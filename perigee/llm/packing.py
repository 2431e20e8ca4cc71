"""Packing of documents into fixed token windows: concatenate and cut.

Pass one tokenizes each partition once, numbers the tokens inside it and writes (partition, start in the
partition, ids) to the shared folder. The partitions' token totals, one number each, become global offsets by
a prefix sum; pass two cuts each document at the multiples of the window length. Nothing is shuffled, and no
document is needed whole next to another one: a window's border is known from numbers alone.

Defined results: a null text counts as empty and gives the end id alone; a null or repeated id is kept as it
is, each row being its own document; other columns are ignored. An empty table gives no pieces.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perigee.llm.common import materialize

#: Entries of the cache from words to ids; it is emptied when full, so a worker's memory stays bounded.
CACHE = 350_000
#: Below U+0180 and in lower case: runs of letters, single digits, runs of other marks.
PIECES = re.compile("[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u017f]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u017f0-9\xb2\xb3\xb9\xbc-\xbe]+")
#: Words of those without apostrophes, blanks and control characters.
PLAIN = re.compile("[!-&(-~\xa1-\xac\xae-\u017f]+")
#: The letters by which a byte-level vocabulary writes bytes that are no visible character of their own.
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
BYTES = {b: 256 + n for n, b in enumerate(_HIDDEN)}
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def width(vocabulary: int) -> int:
    """Bytes of an id while it is on its way."""
    return 2 if vocabulary <= 1 << 16 else 4


class WordEncoder(dict):
    """ids of whole texts by a tokenizer whose pieces never cross white space, little-endian, `width` bytes an id.

    Splitting at ASCII white space first and keeping each word's ids gives what encoding the text gives, as the
    tokenizer drops white space, normalises characters one by one and never joins across it. The dictionary holds the
    words' ids; a word that it lacks is encoded as it is asked for.
    """

    def __init__(self, path: str, most: int = 0):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.width = width(max(size, most + 1))
        self.ids = [i.to_bytes(self.width, "little") for i in range(size)]
        self.merges = self.tokenizer.model.tokenize

    def blobs(self, texts: list[bytes | None]) -> list[bytes]:
        """Each text's ids."""
        if len(self) > CACHE:
            # Short words are the frequent ones; the rest is learned again where it returns.
            short = {w: ids for w, ids in self.items() if len(w) <= 8}
            self.clear()
            self.update(short if len(short) <= CACHE // 2 else {})
        # The tokenizer lower-cases, so case may go first; a special token's string counts in its own case only.
        words = ((t if b"<|" in t else t.translate(LOWER)).split() if t else () for t in texts)
        return [b"".join(map(self.__getitem__, one)) for one in words]

    def __missing__(self, word: bytes) -> bytes:
        """Encodes a word. What the tokenizer's normaliser leaves alone and its pattern cuts only into runs of letters,
        single digits and runs of marks goes straight to its merges; the rest goes through all of it."""
        if word.isalpha() and word.islower():  # ASCII letters alone
            found = self._merged(word.decode())
        elif word[-1:] in (b",", b".") and word[:-1].isalpha() and word[:-1].islower():
            found = self[word[:-1]] + self._merged(word[-1:].decode())
        else:
            text = word.decode("utf-8", "replace")
            if PLAIN.fullmatch(text) and "<|" not in text and text.lower() == text:
                pieces = PIECES.findall(text)
                found = b"".join([self._merged(p) for p in pieces]) if len(pieces) < 3 else b"".join([self[p.encode()] for p in pieces])
            else:
                found = b"".join([self.ids[i] for i in self.tokenizer.encode(text, add_special_tokens=False).ids])
        self[word] = found
        return found

    def _merged(self, piece: str) -> bytes:
        text = piece if piece.isascii() else piece.encode().decode("latin-1").translate(BYTES)
        ids = self.ids
        return b"".join([ids[t.id] for t in self.merges(text)])


def _binary(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, start, id, n, ids): every document's ids with the end id, numbered inside its partition."""
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("id", kind), T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, start, own = TaskContext.get().partitionId(), 0, WordEncoder(tokenizer, end_id)
        end = end_id.to_bytes(own.width, "little")
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                piece = batch.slice(at, 128)
                blobs = [b + end for b in own.blobs(_binary(piece.column(1)))]
                n = np.array([len(b) // own.width for b in blobs], dtype=np.int64)
                starts = start + np.cumsum(n) - n
                start += int(n.sum())
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(n), pa.int32()), pa.array(starts), piece.column(0), pa.array(n), pa.array(blobs, pa.binary())], names=["part", "start", "id", "n", "ids"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(encode, schema)


def pack(docs: DataFrame, tokenizer: str, length: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: id, start (the document's ids before it), length, ids (the piece's ids as little-endian
    32-bit words), doc_tokens, sequence_id, offset. Sequences are full but for the last; see `sequences`.
    """
    done = materialize(tokenized(docs, tokenizer, end_id, id_col, text_col))
    # One number a partition: as many as the scan has splits.
    totals = sorted(done.groupBy("part").agg(F.sum("n").alias("n")).collect())
    parts = np.array([r["part"] for r in totals], dtype=np.int64)
    base = np.cumsum([r["n"] for r in totals]) - np.array([r["n"] for r in totals], dtype=np.int64) if totals else parts
    fields = [T.StructField("id", done.schema["id"].dataType), *(T.StructField(c, T.LongType()) for c in ("start", "length")), T.StructField("ids", T.BinaryType()), *(T.StructField(c, T.LongType()) for c in ("doc_tokens", "sequence_id", "offset"))]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, 128) for b in batches for k in range(0, b.num_rows, 128)):
            at = base[np.searchsorted(parts, batch.column(0).to_numpy())] + batch.column(1).to_numpy()
            n = batch.column(3).to_numpy()
            pieces = (at + n - 1) // length - at // length + 1
            row = np.repeat(np.arange(len(n)), pieces)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            sequence = at[row] // length + nth
            first = np.maximum(at[row], sequence * length)
            last = np.minimum(at[row] + n[row], (sequence + 1) * length)
            ids = _slices(batch.column(4), n, row, first - at[row], last - at[row])
            yield pa.RecordBatch.from_arrays([batch.column(2).take(pa.array(row)), pa.array(first - at[row]), pa.array(last - first), pa.array(ids, pa.binary()), pa.array(n[row]), pa.array(sequence), pa.array(first - sequence * length)], names=[f.name for f in fields])

    return done.mapInArrow(cut, T.StructType(fields))


def _slices(blobs: pa.Array, n: np.ndarray, row: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[bytes]:
    whole = [np.frombuffer(b, dtype=f"<u{len(b) // k}").astype("<u4").tobytes() for b, k in zip(blobs.to_pylist(), n.tolist(), strict=True)]
    return [whole[r][4 * a : 4 * b] for r, a, b in zip(row.tolist(), first.tolist(), last.tolist(), strict=True)]


def sequences(pieces: DataFrame, length: int = 4096, pad_id: int = 0) -> DataFrame:
    """(sequence_id, n, ids): each sequence's ids in order, padded to `length`, except that a sequence whose
    length is a power of two stays as it is. At most `length` pieces meet in a group.
    """
    own = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("n"))
    text = F.array_join(F.transform("p", lambda x: F.hex(x["ids"])), "")
    short = F.lit(length) - F.col("n")
    power = F.col("n").bitwiseAND(F.col("n") - 1) == 0
    pad = f"{pad_id:08x}"
    pad = "".join(reversed([pad[i : i + 2] for i in range(0, 8, 2)]))
    return own.select("sequence_id", "n", F.unhex(F.when(power, text).otherwise(F.concat(text, F.repeat(F.lit(pad), short.cast("int"))))).alias("ids"))
