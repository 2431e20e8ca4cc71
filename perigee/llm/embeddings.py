"""Embedding near-duplicates: PCA-ordered tiled comparison.

Vectors get length one in double precision and turn to the principal axes of all vectors of their dimension (sums of
products per partition, then per group of partitions, then per dimension; one d x d matrix a dimension reaches the
driver), strongest axis first. Equal vectors collapse to one row. Rows are dealt to tiles by ranges of the first
coordinate; two tiles meet unless the gap between their ranges alone already keeps every cosine below the threshold. A
vector travels once and as it was given; a meeting turns its rows itself. There a block of rows accumulates the leading
coordinates of another block in one product; what the remaining coordinates can add is bounded by the product of the
suffix norms. Pairs that can still reach the threshold go on to the next coordinates, and a block pair of which none can
stops. The survivors' cosines are computed whole, from the vectors as given.

A meeting gives, for each row, how many vectors it links to, and a spanning forest of its links: rows in proportion to
the tiles, never all pairs of a group.

Defined results: a vector that is null, empty, zero, or holds null or non-finite components links with nothing, nor
do vectors of different dimensions; it is its own component. Repeated ids are separate vectors that share a name: each
row counts as another vector. A null id takes part and never names a component unless all ids there are null. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perigee.llm.common import connected_components, materialize
from perigee.llm.simhash import Forest

TILE = 8192
BLOCK = 512
#: Coordinates that are accumulated before each look at the bound.
STEP = 16
#: What rounding may take from a bound.
SLACK = 1e-9


def _fine():
    each = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(each & F.exists("v", lambda x: x != 0), F.lit(False))


def usable(vecs: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, v, d): the vectors that can link; single precision stays as it is, anything else becomes double."""
    kind = "array<float>" if vecs.schema[vec_col].dataType.simpleString() == "array<float>" else "array<double>"
    v = vecs.select(F.col(id_col).alias("id"), F.col(vec_col).cast(kind).alias("v"))
    return v.where(_fine()).select("id", "v", F.size("v").alias("d"))


def matrix(vectors: pd.Series) -> np.ndarray:
    """Vectors of one dimension as rows in double precision. Where squares over- or underflow, only the direction counts,
    so each row is divided by its largest component."""
    x = np.vstack([np.asarray(v, dtype=float) for v in vectors])
    return x / np.abs(x).max(axis=1, keepdims=True)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def axes(vecs: DataFrame) -> dict[int, np.ndarray]:
    """By dimension: the principal axes of all vectors, as columns, strongest first."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            for d, own in pdf.groupby("d"):
                x = unit(matrix(own["v"]))
                m = sums.setdefault(int(d), np.zeros((d + 1, d)))
                m[:-1] += x.T @ x
                m[-1] += x.sum(axis=0)
        part = TaskContext.get().partitionId() % 32
        yield pd.DataFrame({"salt": [part] * len(sums), "d": list(sums), "m": [m.tobytes() for m in sums.values()]})

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        d = int(pdf["d"].iloc[0])
        return pd.DataFrame({"salt": [int(pdf["salt"].iloc[0])], "d": [d], "m": [sum(np.frombuffer(m).reshape(d + 1, d) for m in pdf["m"]).tobytes()]})

    sums = vecs.select("d", "v").mapInPandas(partial, "salt int, d int, m binary").groupBy("salt", "d").applyInPandas(total, "salt int, d int, m binary")
    sums = sums.groupBy("d").applyInPandas(total, "salt int, d int, m binary")  # 32 matrices at most meet
    counts = {r["d"]: r["n"] for r in vecs.groupBy("d").agg(F.count("*").alias("n")).collect()}
    out = {}
    for r in sums.toLocalIterator():  # one matrix a dimension
        d, m = r["d"], np.frombuffer(r["m"]).reshape(r["d"] + 1, r["d"])
        # About the origin, not the mean: cosines are products of the vectors themselves.
        values, columns = np.linalg.eigh(m[:-1] / counts[d])
        out[d] = np.ascontiguousarray(columns[:, np.argsort(-values)])
    return out


def near_pairs(x: np.ndarray, y: np.ndarray, sx: np.ndarray, sy: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows i of x and j of y whose products can reach the threshold; sx, sy: norms of what follows each step."""
    d = x.shape[1]
    done = min(STEP, d)
    bound = np.concatenate([x[:, :done], sx[:, :1]], axis=1) @ np.concatenate([y[:, :done], sy[:, :1]], axis=1).T
    i, j = np.nonzero(bound >= threshold - SLACK)
    if not len(i):
        return i, j
    so_far = np.einsum("ij,ij->i", x[i, :done], y[j, :done])
    k = 1
    while done < d and len(i):
        to = min(done + STEP, d)
        so_far += np.einsum("ij,ij->i", x[i, done:to], y[j, done:to])
        able = so_far + sx[i, k] * sy[j, k] >= threshold - SLACK
        i, j, so_far, done, k = i[able], j[able], so_far[able], to, k + 1
    return i, j


def suffix_norms(x: np.ndarray) -> np.ndarray:
    """Column k: the norm of what follows the first (k + 1) steps."""
    ends = [min(s, x.shape[1]) for s in range(STEP, x.shape[1] + STEP, STEP)]
    return np.stack([np.sqrt((x[:, e:] ** 2).sum(axis=1)) for e in ends], axis=1)


def tile_links(x: np.ndarray, raw: np.ndarray, weight: np.ndarray, split: int | None, threshold: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Linked weight of each row, and a spanning forest. split: where the second tile begins; None within one tile."""
    n = len(x)
    linked, forest, links = np.zeros(n, dtype=np.int64), Forest(n), []
    s, norm = suffix_norms(x), np.sqrt((raw * raw).sum(axis=1))
    for a in range(0, n if split is None else split, BLOCK):
        b = min(a + BLOCK, n if split is None else split)
        for c in range(a if split is None else split, n, BLOCK):
            e = min(c + BLOCK, n)
            i, j = near_pairs(x[a:b], x[c:e], s[a:b], s[c:e], threshold)
            i, j = i + a, j + c
            if c == a:
                i, j = i[i < j], j[i < j]
            for at in range(0, len(i), 65_536):
                p, q = i[at : at + 65_536], j[at : at + 65_536]
                cosine = np.einsum("ij,ij->i", raw[p], raw[q]) / (norm[p] * norm[q])
                p, q = p[cosine >= threshold], q[cosine >= threshold]
                np.add.at(linked, p, weight[q])
                np.add.at(linked, q, weight[p])
                links += forest.join(p, q)
    return linked, links


def embedding_groups(vecs: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9, tile: int = TILE) -> DataFrame:
    """(id, n_links, component_id, kept) for every row of vecs."""
    fine = materialize(usable(vecs, id_col, vec_col).withColumns({"k1": F.xxhash64("v"), "k2": F.xxhash64(F.lit(7), "v")}))
    basis = axes(fine)
    distinct = fine.groupBy("k1", "k2").agg(F.min("id").alias("first"), F.count("*").alias("n"), F.first("v").alias("v"), F.first("d").alias("d"))

    @F.pandas_udf("double")
    def lead(v: pd.Series) -> pd.Series:
        """The first coordinate on the principal axes."""
        size, out = v.map(len).to_numpy(), np.zeros(len(v))
        for d in np.unique(size):
            out[size == d] = unit(matrix(v[size == d])) @ basis[int(d)][:, 0]
        return pd.Series(out)

    distinct = materialize(distinct.withColumn("c", lead("v")))
    # Tiles: ranges of the first coordinate. Only the number of rows of each of 2048 ranges goes to the driver.
    cell = F.least(F.lit(2047), F.greatest(F.lit(0), F.floor((F.col("c") + 1) * 1024))).cast("int")
    counts = {(r["d"], r["c"]): r["n"] for r in distinct.groupBy("d", cell.alias("c")).agg(F.count("*").alias("n")).collect()}
    tiles, of, filled = [], {}, 0  # (dimension, first cell, last cell, parts)
    for d, c in sorted(counts):
        n = counts[d, c]
        if tiles and tiles[-1][0] == d and filled + n <= tile:
            tiles[-1][2], filled = c, filled + n
        else:
            tiles.append([d, c, c, max(1, -(-n // tile))])
            filled = n
        of[d, c] = len(tiles) - 1
    # A range with more rows than a tile holds is dealt to parts by hash.
    first = np.cumsum([0, *(t[3] for t in tiles)]).tolist()
    reach = (2 - 2 * threshold) ** 0.5 if threshold > -1 else 2.0

    @F.pandas_udf("array<struct<lo:int,hi:int,me:int>>")
    def meetings(d: pd.Series, c: pd.Series, h: pd.Series) -> pd.Series:
        out = []
        for dim, own, salt in zip(d, c, h, strict=True):
            t = of[dim, own]
            me = first[t] + salt % tiles[t][3]
            meets = [u for u, (e, lo, hi, _) in enumerate(tiles) if e == dim and max(lo - tiles[t][2] - 1, tiles[t][1] - hi - 1) / 1024 <= reach]
            out.append([{"lo": min(me, p), "hi": max(me, p), "me": me} for u in meets for p in range(first[u], first[u + 1])])
        return pd.Series(out)

    dealt = distinct.select("k1", "k2", "n", "v", F.explode(meetings("d", cell, F.pmod("k1", F.lit(1 << 20)))).alias("m")).select("k1", "k2", "n", "v", "m.*")

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = pdf["lo"].iloc[0], pdf["hi"].iloc[0]
        pdf = pdf.sort_values("me", kind="stable")
        split = None if lo == hi else int((pdf["me"] == lo).sum())
        if split in (0, len(pdf)):
            return pd.DataFrame({c: np.zeros(0, dtype=np.int64) for c in ("k1", "k2", "links", "o1", "o2")})
        k1, k2, weight = (pdf[c].to_numpy() for c in ("k1", "k2", "n"))
        raw = matrix(pdf["v"])
        linked, forest = tile_links(unit(raw) @ basis[raw.shape[1]], raw, weight, split, threshold)
        rows = np.nonzero(linked)[0]
        a, b = (np.array([f[s] for f in forest], dtype=np.int64) for s in (0, 1))
        none = np.zeros(len(rows), dtype=np.int64)
        return pd.DataFrame({"k1": np.concatenate([k1[rows], k1[a]]), "k2": np.concatenate([k2[rows], k2[a]]), "links": np.concatenate([linked[rows], np.zeros(len(a), dtype=np.int64)]), "o1": np.concatenate([none, k1[b]]), "o2": np.concatenate([none, k2[b]])})

    met = materialize(dealt.groupBy("lo", "hi").applyInPandas(meet, "k1 long, k2 long, links long, o1 long, o2 long"))
    degrees = materialize(met.where("links > 0").groupBy("k1", "k2").agg(F.sum("links").alias("links")))
    pair = lambda a, b: F.struct(F.col(a).alias("k1"), F.col(b).alias("k2"))
    roots = connected_components(met.where("links = 0").select(pair("k1", "k2").alias("a"), pair("o1", "o2").alias("b")))
    roots = roots.select("node.k1", "node.k2", "root")
    named = distinct.select("k1", "k2", "first", "n").join(roots, ["k1", "k2"], "left").join(degrees, ["k1", "k2"], "left")
    # Written before they are joined, so that the rows of a frequent name can be split.
    named = materialize(named.withColumn("root", F.coalesce("root", F.struct("k1", "k2"))))
    names = materialize(named.groupBy("root").agg(F.min("first").alias("component_id")))
    named = materialize(named.join(names, "root").select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), "component_id"))
    linked = fine.select("id", "k1", "k2").join(named, ["k1", "k2"]).select("id", "links", "component_id")
    v = vecs.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    alone = v.where(~_fine()).select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("component_id"))
    rows = linked.unionByName(alone)
    return rows.select("id", F.col("links").alias("n_links"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
