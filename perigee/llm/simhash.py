"""SimHash near-duplicates: tiled exact comparison of 64-bit fingerprints.

Exact copies of a fingerprint collapse first, so a large group of copies is one row. Distinct fingerprints are
dealt to tiles by population count; two tiles meet only if their counts differ by at most the radius. Inside a
meeting, blocks of 256 rows ordered by the counts of the four 16-bit quarters skip one another by the same bound
summed over quarters; the rest are compared by exclusive-or and bit count in numpy. A meeting gives a spanning
forest of its links, never all pairs of a group, and connected components join the forests.

Groups by similarity (`similar_groups`): texts link if their sets of word shingles have a Jaccard similarity of at
least `similarity`. Equal sets collapse. Small sets (up to SMALL shingles) meet by keys: at similarity 0.8 two of them
are linked only if one is the other without one shingle, or both have SMALL and one differs, so the hashes of a set and
of it without each shingle in turn find their links exactly; a group of thousands gives one link a member. Where a set
is larger, candidates are pairs whose sizes allow it and whose fingerprints over the sets, 512 bits here, differ in at
most RADII[-1] bits, and the sets of each candidate pair are compared exactly. At similarity 0.8 some 79 bits differ,
with a standard deviation of 8. The passes widen: the first ones propose a forest of the nearest candidates a meeting,
so that groups of copies grow together by few links; the last proposes all candidate pairs between what is still apart,
so no link is missed.

Defined results: a null or empty text, or one without words, has fingerprint zero and links like any other; a
null id takes part and never is a component's name unless all its members' ids are null; repeated rows are copies;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perigee.llm.common import connected_components, materialize

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Fingerprints in a tile at most, about: a worker holds two tiles.
TILE = 32_768
BLOCK = 256
#: Shingles of a small set, by keys; 64-bit words of a set's fingerprint; bits that may differ in each pass, and in the
#: first one and two words: more than five standard deviations above what similarity 0.8 gives.
SMALL, WORDS = 9, 8
RADII = (72, 96, 123)
FIRST, SECOND = 26, 42
#: Names of candidates' sets that are broadcast at a time.
NEED = 1_000_000


def fingerprint(text: bytes | None, size: int = 3) -> int:
    """A bit is set if it is set in over half the hashes of the text's word shingles."""
    from xxhash import xxh64_intdigest

    words = (text or b"").translate(LOWER).split()
    if not words:
        return 0
    if len(words) <= size:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False))
    h = np.array([xxh64_intdigest(s, 42) for s in shingles], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 65_536):
        ones += np.unpackbits(h[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(id, sum, fp): fp is the fingerprint as a signed long, sum a hash of the text, which tells rows of one id apart."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("sum", T.LongType()), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            fp = np.array([fingerprint(t.as_py(), size) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(fp, pa.int64())], names=["id", "sum", "fp"])

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("sum"), text.alias("text")).mapInArrow(run, schema)


def _quarters(fp: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fp.view(np.uint16).reshape(-1, 4)).astype(np.int16)


class Forest:
    """Union of rows; `join` returns the links that joined two trees."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
        made: list[tuple[int, int]] = []
        while len(i):
            a, b = self.root[i], self.root[j]
            differ = a != b
            if not differ.any():
                break
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            high, low = np.maximum(a, b), np.minimum(a, b)
            # Each tree hooks on to one lower tree, so no circle arises; the rest wait for the next turn.
            tree, first = np.unique(high, return_index=True)
            made += zip(i[first].tolist(), j[first].tolist(), strict=True)
            self.root[tree] = low[first]
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up
        return made


def tile_links(a: np.ndarray, b: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between the values of a and b, or within a, as pairs of values."""
    both = a if b is None else np.concatenate([a, b])
    quarter = _quarters(both)
    order = np.lexsort(quarter.T[::-1])
    if b is not None:
        order = np.concatenate([order[order < len(a)], order[order >= len(a)]])
    both, quarter = both[order], quarter[order]
    edges = [*range(0, len(a), BLOCK), *range(len(a), len(both), BLOCK)]
    ends = [min(e + BLOCK, len(a) if e < len(a) else len(both)) for e in edges]
    low = np.array([quarter[s:e].min(axis=0) for s, e in zip(edges, ends, strict=True)])
    high = np.array([quarter[s:e].max(axis=0) for s, e in zip(edges, ends, strict=True)])
    mine = (len(a) + BLOCK - 1) // BLOCK
    forest, links = Forest(len(both)), []
    for k in range(mine):
        others = np.arange(k, mine) if b is None else np.arange(mine, len(edges))
        apart = np.maximum(0, np.maximum(low[others] - high[k], low[k] - high[others])).sum(axis=1)
        near = others[apart <= radius]
        rows = both[edges[k] : ends[k]]
        for at in range(0, len(near), 32):
            cols = np.concatenate([np.arange(edges[x], ends[x]) for x in near[at : at + 32]])
            i, j = np.nonzero(np.bitwise_count(rows[:, None] ^ both[cols][None, :]) <= radius)
            links += forest.join(i + edges[k], cols[j])
    return [(int(both[i]), int(both[j])) for i, j in links]


def links(distinct: DataFrame, radius: int = 3, tile: int = TILE) -> DataFrame:
    """(a, b): links between the distinct values of column fp that keep every component connected."""
    counts = {r["pop"]: r["n"] for r in distinct.groupBy(F.bit_count("fp").alias("pop")).agg(F.count("*").alias("n")).collect()}  # 65 rows at most
    tiles = [-(-counts.get(p, 0) // tile) for p in range(65)]
    first = np.cumsum([0, *tiles]).tolist()
    if not counts:
        return distinct.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    from_, to = [first[max(0, p - radius)] for p in range(65)], [first[min(65, p + radius + 1)] - 1 for p in range(65)]
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), F.bit_count("fp") + 1)
    own = pick(first[:65]) + F.pmod(F.xxhash64("fp"), F.greatest(pick(tiles), F.lit(1)))
    dealt = distinct.select("fp", own.cast("int").alias("t"), F.explode(F.sequence(pick(from_), pick(to))).alias("u"))
    dealt = dealt.select("fp", "t", F.least("t", "u").alias("lo"), F.greatest("t", "u").alias("hi"))

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        fp, t, lo, hi = pdf["fp"].to_numpy(), pdf["t"].to_numpy(), pdf["lo"].iloc[0], pdf["hi"].iloc[0]
        a = np.ascontiguousarray(fp[t == lo]).view(np.uint64)
        b = None if lo == hi else np.ascontiguousarray(fp[t == hi]).view(np.uint64)
        found = np.array(tile_links(a, b, radius) if len(a) and (b is None or len(b)) else [], dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"a": found[:, 0], "b": found[:, 1]})

    return dealt.groupBy("lo", "hi").applyInPandas(meet, "a long, b long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, size: int = 3) -> DataFrame:
    """(id, sum, fp, root, component_id): root is a fingerprint that names the component, component_id the
    smallest id that links reach."""
    fps = materialize(fingerprints(docs, id_col, text_col, size))
    distinct = materialize(fps.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")))
    roots = connected_components(links(distinct, radius))
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").where("root is not null or n > 1").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    # Written before they are joined, so that the rows of a frequent name or fingerprint can be split.
    named = materialize(named)
    names = materialize(named.groupBy("root").agg(F.min("first").alias("component_id")))
    named = materialize(named.join(names, "root").select(F.col("fp").alias("of"), "root", "component_id"))
    return fps.join(named, fps["fp"] == named["of"], "left").select("id", "sum", "fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "id").alias("component_id"))


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    """The distinct hashes of the text's word shingles, in order; all its words are one shingle where they are fewer."""
    from xxhash import xxh64_intdigest

    words = (text or b"").translate(LOWER).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    shingles = [b" ".join(words)] if len(words) <= size else map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False))
    return np.unique(np.array([xxh64_intdigest(s, 42) for s in shingles], dtype=np.uint64))


def set_fingerprint(h: np.ndarray) -> bytes:
    """A bit for each of 64 x WORDS hash bits: whether over half the hashes, mixed anew for each word, have it."""
    ones = np.zeros(64 * WORDS, dtype=np.int64)
    turn = np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(h), 8192):
        x = h[at : at + 8192, None] + turn
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        ones += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return np.packbits(2 * ones > len(h), bitorder="little").tobytes()


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, sum, sig, n, bits, without, shingles): sig names the set, of n hashes; bits is its fingerprint; without: the
    names of a small set without each of its hashes."""
    longs = [T.StructField(c, T.LongType()) for c in ("sum", "sig", "n")]
    lists = [T.StructField(c, T.ArrayType(T.LongType())) for c in ("without", "shingles")]
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *longs, T.StructField("bits", T.BinaryType()), *lists])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        name = lambda h: xxh64_intdigest(h.tobytes(), 42)
        signed = lambda x: pa.array(np.array(x, dtype=np.uint64).view(np.int64))
        ends = lambda lists: pa.array(np.cumsum([0, *map(len, lists)]).astype(np.int32))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_set(t.as_py(), size) for t in part.column(2).cast(pa.binary())]
                without = [[name(np.delete(h, k)) for k in range(len(h))] if len(h) <= SMALL else [] for h in sets]
                shingles = pa.ListArray.from_arrays(ends(sets), signed(np.concatenate(sets)))
                keys = pa.ListArray.from_arrays(ends(without), signed([k for w in without for k in w]))
                bits = pa.array([set_fingerprint(h) if len(h) >= SMALL - 1 else b"" for h in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:2], signed([name(h) for h in sets]), pa.array(list(map(len, sets)), pa.int64()), bits, keys, shingles], names=schema.names)

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("sum"), text.alias("text")).mapInArrow(run, schema)


def small_links(distinct: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links between small sets (sig, n, without) that connect what similarity connects."""
    able = lambda k, more: k >= similarity * (k + more) - 1e-9
    owners = distinct.where(F.col("n").between(2, SMALL)).select(F.col("sig").alias("b"), F.col("n").alias("m"), F.explode("without").alias("key"))
    owners = materialize(owners.where(F.col("m").isin([m for m in range(2, SMALL + 1) if able(m - 1, 1)])))
    whole = distinct.where(F.col("n") < SMALL).select(F.col("sig").alias("a"))
    links = owners.join(whole, F.col("key") == F.col("a")).select("a", "b")
    # One shingle replaced: all that share a key are similar to one another, so each hangs from the first.
    same = owners.where(F.col("m").isin([m for m in range(2, SMALL + 1) if able(m - 1, 2)]))
    first = materialize(same.groupBy("key").agg(F.min("b").alias("a"), F.count("*").alias("c")).where("c > 1"))
    return links.union(same.join(first, "key").where("a <> b").select("a", "b"))


def set_candidates(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray] | None, similarity: float, radius: int, forest: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places, in a and b one after the other, of the candidate pairs between a and b, or within a. Each is (rows of label
    and n, fingerprints). Pairs of one label don't count; forest: only as many as join what is not joined yet."""
    both = a[0] if b is None else np.concatenate([a[0], b[0]])
    bits = a[1] if b is None else np.concatenate([a[1], b[1]])
    label, n = both[:, 0], both[:, 1]
    order = np.argsort(a[0][:, 1], kind="stable")
    other = order if b is None else len(a[0]) + np.argsort(b[0][:, 1], kind="stable")
    size, word = n[other], bits[:, 0].copy()
    tree, found = Forest(len(both)), []
    for at in range(0, len(order), BLOCK):
        rows = order[at : at + BLOCK]
        low, high = n[rows[0]], n[rows[-1]]
        first = max(np.searchsorted(size, np.floor(low * similarity)), at if b is None else 0)
        end = np.searchsorted(size, np.ceil(high / similarity), side="right")
        for start in range(first, end, 32 * BLOCK):
            cols = other[start : min(end, start + 32 * BLOCK)]
            i, j = np.nonzero(np.bitwise_count(word[rows][:, None] ^ word[cols][None, :]) <= min(FIRST, radius))
            i, j = rows[i], cols[j]
            small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
            good = (large > SMALL) & (small >= large * similarity - 1e-9) & (label[i] != label[j])
            i, j = i[good], j[good]
            for words, most in ((2, min(SECOND, radius)), (WORDS, radius)):
                near = np.zeros(len(i), dtype=bool)
                for k in range(0, len(i), 1 << 16):
                    x, y = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                    near[k : k + (1 << 16)] = np.bitwise_count(bits[x, :words] ^ bits[y, :words]).sum(axis=1, dtype=np.int64) <= most
                i, j = i[near], j[near]
            if b is None:
                i, j = np.minimum(i, j), np.maximum(i, j)
            if forest and len(i):
                made = np.array(tree.join(i, j), dtype=np.int64).reshape(-1, 2)
                i, j = made[:, 0], made[:, 1]
            found.append((i, j))
    pairs = np.unique(np.concatenate([np.stack(f, axis=1) for f in found]), axis=0) if found else np.zeros((0, 2), dtype=np.int64)
    return pairs[:, 0], pairs[:, 1]


def similar_candidates(distinct: DataFrame, similarity: float, radius: int, forest: bool, tile: int = TILE) -> DataFrame:
    """(a, b): candidate pairs among the rows (sig, label, n, bits) of different labels, of which one is not small."""
    # Sizes in one class or in neighbours: similar sets are never further apart.
    rows = distinct.where(F.col("n") >= SMALL - 1).withColumn("c", F.floor(F.ln("n") / F.lit(-np.log(similarity) * (1 + 1e-9))).cast("int"))
    counts = {r["c"]: r["k"] for r in rows.groupBy("c").agg(F.count("*").alias("k")).collect()}  # some hundred rows at most
    if not counts:
        return distinct.select(F.col("sig").alias("a"), F.col("sig").alias("b")).limit(0)
    classes = max(counts) + 1
    tiles = [-(-counts.get(c, 0) // tile) for c in range(classes)]
    first = np.cumsum([0, *tiles]).tolist()
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("c") + 1)
    own = pick(first[:classes]) + F.pmod(F.xxhash64("sig"), F.greatest(pick(tiles), F.lit(1)))
    to = [first[min(classes, c + 2)] - 1 for c in range(classes)]
    from_ = [first[max(0, c - 1)] for c in range(classes)]
    dealt = rows.select("sig", "label", "n", "bits", own.cast("int").alias("t"), F.explode(F.sequence(pick(from_), pick(to))).alias("u"))
    dealt = dealt.withColumns({"lo": F.least("t", "u"), "hi": F.greatest("t", "u")})

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        t, lo, hi = pdf["t"].to_numpy(), pdf["lo"].iloc[0], pdf["hi"].iloc[0]
        cells = np.ascontiguousarray(pdf[["label", "n"]].to_numpy(dtype=np.int64))
        bits = np.frombuffer(b"".join(pdf["bits"]), dtype=np.uint64).reshape(-1, WORDS)
        names = pdf["sig"].to_numpy()
        mine = np.concatenate([np.nonzero(t == lo)[0], np.nonzero(t == hi)[0] if lo != hi else np.zeros(0, dtype=np.int64)])
        split = int((t == lo).sum())
        left, right = mine[:split], mine[split:]
        if not len(left) or (lo != hi and not len(right)):
            return pd.DataFrame({"a": np.zeros(0, dtype=np.int64), "b": np.zeros(0, dtype=np.int64)})
        i, j = set_candidates((cells[left], bits[left]), None if lo == hi else (cells[right], bits[right]), similarity, radius, forest)
        return pd.DataFrame({"a": names[mine[i]], "b": names[mine[j]]})

    return dealt.groupBy("lo", "hi").applyInPandas(meet, "a long, b long")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8, tile: int = TILE, block: int = NEED) -> DataFrame:
    """(id, sum, root): root names the component of verified links. similarity: 0.8 or more."""
    if similarity < 0.8:
        raise ValueError("fingerprints and keys are laid out for a similarity of 0.8 or more")
    sets = materialize(shingle_sets(docs, id_col, text_col, size))
    distinct = materialize(sets.groupBy("sig").agg(*(F.first(c).alias(c) for c in ("n", "bits", "without"))))

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = materialize(pairs.distinct())
        need = materialize(pairs.select(F.explode(F.array("a", "b")).alias("need")).distinct())
        # Block by block, so that the sets that no candidate needs are never shuffled.
        blocks = max(1, -(-need.count() // block))
        own = [need.where(F.pmod(F.xxhash64("need"), F.lit(blocks)) == k) for k in range(blocks)]
        found = [sets.select("sig", "shingles").join(F.broadcast(n), F.col("sig") == F.col("need"), "left_semi") for n in own]
        texts = materialize(reduce(DataFrame.unionByName, found).dropDuplicates(["sig"]))
        mine = texts.select(F.col("sig").alias("a"), F.col("shingles").alias("s"))
        other = texts.select(F.col("sig").alias("b"), F.col("shingles").alias("o"))
        both = pairs.join(mine, "a").join(other, "b").withColumn("common", F.size(F.array_intersect("s", "o")))
        return materialize(both.where(F.col("common") >= similarity * (F.size("s") + F.size("o") - F.col("common")) - 1e-9).select("a", "b"))

    def labelled(edges: DataFrame) -> DataFrame:
        roots = connected_components(edges)
        named = distinct.join(roots, F.col("sig") == F.col("node"), "left")
        return materialize(named.select("sig", "n", "bits", F.coalesce("root", "sig").alias("label")))

    edges = materialize(small_links(distinct, similarity))
    now = distinct.withColumn("label", F.col("sig"))
    for radius in RADII:
        edges = edges.union(verified(similar_candidates(now, similarity, radius, radius != RADII[-1], tile)))
        now = labelled(edges)
    named = now.select(F.col("sig").alias("of"), F.col("label").alias("root"))
    return sets.select("id", "sum", "sig").join(named, F.col("sig") == F.col("of")).select("id", "sum", "root")


def hex_fingerprint(column: str) -> Column:
    return F.lpad(F.lower(F.hex(column)), 16, "0")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, size: int = 3, similarity: float | None = None) -> DataFrame:
    """One row of each group, as it is: that with the smallest id (null ids last; of rows that share it, the one
    whose text hashes lowest; of equal rows, one). With a similarity, groups link by it (`radius` has no part then)."""
    groups = simhash_groups(docs, id_col, text_col, radius, size) if similarity is None else similar_groups(docs, id_col, text_col, size, similarity)
    key = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    leads = groups.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "sum")).alias("lead"))
    leads = leads.select(key(F.col("lead.id")).alias("__perigee_lead"), F.col("lead.sum").alias("__perigee_lead_sum"))
    keyed = docs.withColumns({"__perigee_id": key(docs[id_col]), "__perigee_sum": F.xxhash64(docs[text_col].cast("string"))})
    kept = keyed.join(leads, (F.col("__perigee_id") == F.col("__perigee_lead")) & (F.col("__perigee_sum") == F.col("__perigee_lead_sum")), "left_semi")
    return kept.dropDuplicates(["__perigee_id", "__perigee_sum"]).drop("__perigee_id", "__perigee_sum")
