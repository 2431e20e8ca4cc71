"""Token counts that follow edits: a segment tree of pre-tokens per document.

A byte-level tokenizer cuts a text into pre-tokens by a pattern and never merges across them, so a text's count is the
sum of its pre-tokens' counts. The tree's leaves are blocks of up to 64 pre-tokens with their lengths and counts; its
inner nodes hold the sums of both, so the block at a character offset is found, and a change carried up, in a
logarithm of the text's length. An edit replaces some characters: pre-tokens are made anew from the last border two or
more characters before it (what the pattern can look ahead) until a border falls on an old border behind it; from
there on the old ones hold. Only the blocks in between are rewritten, each with its own piece of the text, so an edit
costs what it touches and not what the text has.

Defined results: a null text counts as empty and has no tokens; edits apply in their order, each to the text that the
one before left; offsets are cut to the text, a null replacement is empty, an edit without a start or end is skipped;
repeated rows are counted alike, null ids pass through, other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 64
CACHE = 250_000
Edit = tuple[int, int, str]
Block = tuple[str, list[int], list[int]]
#: E-mail addresses and long numbers. An address begins behind what can't be in it and gives no run back, so that no
#: part of a text is scanned twice.
_PRIVATE = r"(?<![\w.+-])[\w.+-]++@[\w-]++(?:\.[\w-]++)+|\+?\d[\d ()-]{6,}\d"


class Counter:
    """Token counts of pre-tokens by a tiktoken vocabulary file and its pattern."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.pattern, self.cache = regex.compile(pattern), {}

    def counts(self, pieces: list[str]) -> list[int]:
        cache = self.cache
        if len(cache) > CACHE:
            cache.clear()
        out = list(map(cache.get, pieces))
        if None in out:
            for k, n in enumerate(out):
                if n is None:
                    p = pieces[k]
                    out[k] = cache[p] = cache.get(p) or len(self.encode(p))
        return out

    def total(self, text: str | None) -> int:
        return sum(self.counts(self.pattern.findall(text or "")))


class Tree:
    """A text in blocks of pre-tokens, and a segment tree of the blocks' characters and tokens.

    A block is (its characters, the lengths of its pre-tokens, their token counts); no edit copies more of the text than
    the blocks that it touches and one more at each side.
    """

    def __init__(self, text: str, counter: Counter):
        self.counter, self.encoded = counter, 0
        pieces = counter.pattern.findall(text)
        self._plant(self._cut(pieces, counter.counts(pieces)))

    @staticmethod
    def _cut(pieces: list[str], counts: list[int]) -> list[Block]:
        return [("".join(p := pieces[k : k + BLOCK]), list(map(len, p)), counts[k : k + BLOCK]) for k in range(0, len(pieces), BLOCK)]

    def _plant(self, blocks: list[Block]) -> None:
        self.blocks = blocks or [("", [], [])]
        self.width = 1 << (len(self.blocks) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for k, (text, _, c) in enumerate(self.blocks):
            self.chars[self.width + k], self.tokens[self.width + k] = len(text), sum(c)
        for k in range(self.width - 1, 0, -1):
            self.chars[k], self.tokens[k] = self.chars[2 * k] + self.chars[2 * k + 1], self.tokens[2 * k] + self.tokens[2 * k + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def text(self) -> str:
        return "".join(b[0] for b in self.blocks)

    def _find(self, at: int) -> tuple[int, int]:
        """The block that holds character `at` (the last block for the text's end) and the offset of its beginning."""
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if at - start >= self.chars[node] and start + self.chars[node] < self.chars[1]:
                start += self.chars[node]
                node += 1
        return node - self.width, start

    def _set(self, k: int, block: Block) -> None:
        self.blocks[k] = block
        node = self.width + k
        self.chars[node], self.tokens[node] = len(block[0]), sum(block[2])
        while node > 1:
            node //= 2
            self.chars[node], self.tokens[node] = self.chars[2 * node] + self.chars[2 * node + 1], self.tokens[2 * node] + self.tokens[2 * node + 1]

    def edit(self, start: int, end: int, new: str) -> None:
        start = min(max(start, 0), self.chars[1])
        end = min(max(end, start), self.chars[1])
        # The last border at least two characters before the edit.
        first, base = self._find(max(0, start - 2))
        head, skip = 0, 0
        for size in self.blocks[first][1]:
            if base + skip + size > start - 2:
                break
            skip += size
            head += 1
        # New pre-tokens of the blocks around the edit until one ends at an old border behind it. One that reaches the
        # end of what has been looked at may go on in the next blocks, so more of them are looked at: twice as many.
        last, _ = self._find(end)
        more = 1
        while True:
            last = min(last + more, len(self.blocks) - 1)
            whole = "".join(b[0] for b in self.blocks[first : last + 1])
            text = whole[skip : start - base] + new + whole[end - base :]
            moved = len(new) - (end - start)
            borders, at = {}, 0
            for k in range(first, last + 1):
                for n, size in enumerate(self.blocks[k][1]):
                    if at >= end - base:
                        borders[at] = (k, n)
                    at += size
            fresh, here, done = [], 0, None
            final = last == len(self.blocks) - 1
            for match in self.counter.pattern.finditer(text):
                if not final and match.end() + 2 > len(text):
                    break
                fresh.append(match[0])
                here = match.end() + skip - moved
                if here >= end - base and here in borders:
                    done = borders[here]
                    break
            if done or final:
                break
            more *= 2
        k, n = done or (last, len(self.blocks[last][1]))
        _, sizes, counts = self.blocks[k]
        tail = self.blocks[k][0][sum(sizes[:n]) :]
        before = self.blocks[first]
        self.encoded += len(fresh)
        pieces = [before[0][:skip], *fresh, tail]
        text, sizes = "".join(pieces), before[1][:head] + list(map(len, fresh)) + sizes[n:]
        counts = before[2][:head] + self.counter.counts(fresh) + counts[n:]
        self._lay(first, k, text, sizes, counts)

    def _lay(self, first: int, last: int, text: str, sizes: list[int], counts: list[int]) -> None:
        """Puts pre-tokens in the place of the blocks from `first` to `last`."""
        room = last - first + 1
        step = BLOCK if len(sizes) > 4 * BLOCK * room else max(1, -(-len(sizes) // room))
        made, at = [], 0
        for k in range(0, max(len(sizes), 1), step):
            to = at + sum(sizes[k : k + step])
            made.append((text[at:to], sizes[k : k + step], counts[k : k + step]))
            at = to
        if len(made) > room:  # a long insertion: the tree grows
            self._plant(self.blocks[:first] + made + self.blocks[last + 1 :])
            return
        for k in range(room):
            self._set(first + k, made[k] if k < len(made) else ("", [], []))


def count_tokens(docs: DataFrame, path: str, pattern: str, edits: Callable[[str], list[Edit]] | DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_pretokens, n_edits, n_tokens_after, n_reencoded, text_after) of every row of docs.

    edits: a function from a text to its edits, or rows (id, seq, start, end, new) that apply by their seq to every
    row of docs with that id. n_reencoded counts the pre-tokens that edits made anew.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = "array<struct<seq:bigint,start:bigint,end:bigint,new:string>>"
    if isinstance(edits, DataFrame):
        own = edits.groupBy(F.col("id").alias("of")).agg(F.sort_array(F.collect_list(F.struct(F.col("seq").cast("bigint").alias("seq"), F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), "new"))).alias("edits"))
        rows = rows.join(own, F.col("id").eqNullSafe(F.col("of")), "left").select("id", "text", F.col("edits").cast(kind).alias("edits"))
        find = None
    else:
        rows, find = rows.withColumn("edits", F.lit(None).cast(kind)), edits
    names = ("n_tokens", "n_pretokens", "n_edits", "n_tokens_after", "n_reencoded")
    schema = T.StructType([rows.schema["id"], *(T.StructField(c, T.LongType()) for c in names), T.StructField("text_after", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                out: list[tuple] = []
                for text, given in zip(some.column(1), some.column(2).to_pylist(), strict=True):
                    text = text.as_py()
                    todo = [(e["start"], e["end"], e["new"] or "") for e in given or [] if e["start"] is not None and e["end"] is not None]
                    todo = find(text) if find and text else todo
                    if not todo:
                        pieces = counter.pattern.findall(text or "")
                        n = sum(counter.counts(pieces))
                        out.append((n, len(pieces), 0, n, 0, text))
                        continue
                    tree = Tree(text or "", counter)
                    before, size = tree.n_tokens, sum(len(b[1]) for b in tree.blocks)
                    for e in todo:
                        tree.edit(*e)
                    out.append((before, size, len(todo), tree.n_tokens, tree.encoded, tree.text))
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([some.column(0), *(pa.array(np.array(c, dtype=np.int64)) for c in columns[:5]), pa.array(columns[5], pa.string())], names=[f.name for f in schema])

    return rows.mapInArrow(run, schema)


def redactions(text: str) -> list[Edit]:
    """Edits that replace e-mail addresses and long digit runs, from the text's end to its beginning."""
    import re

    return [(m.start(), m.end(), "[redacted]") for m in re.finditer(_PRIVATE, text)][::-1]
