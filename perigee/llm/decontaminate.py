"""Benchmark decontamination by spaced-seed hashing.

Tokens are runs of letters or digits, lower-cased. A mask picks some of the token positions behind a start and
ignores the others, so a replaced token spoils only the masks that pick it. The hashes of all benchmark starts
meet the hashes of all document starts; around each hit the benchmark item is laid over the document at the hit's
offset, and the item counts as found if some `window` consecutive item tokens (all of them where the item is
shorter) agree in at least `similarity` of their places.

Items shorter than the window have masks of their own length, which pick from the whole item: enough of them that
whichever tokens may differ, one mask ignores them all. So nothing is missed at any length.

Only DataFrame expressions are used. The benchmark is the query set: it is cut into blocks whose hashes are few
enough to broadcast, and each block meets all documents in one pass without any shuffle of their tokens. Only
hits, with the piece of the document that the item covers, go on. A benchmark of more than `most_blocks` blocks is
joined by its shuffled hashes instead, which the documents' starts then meet without their tokens; the pieces are
fetched for the hits. Both ways give the same rows.

Defined results: null or empty texts have no tokens; an item without tokens is never found; a null id is reported
as null; repeated rows give one row an (id, item_id), the best one (agreeing most, then earliest); an item may hang
over a document's ends, where its tokens agree with nothing; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Positions that each mask picks. Whichever two tokens of 13 differ, one of the masks still hits (a test tries all
#: pairs), so with these masks, window and similarity nothing is missed in items of 13 tokens or more.
MASKS = ((0, 1, 2, 4, 7), (0, 1, 3, 5, 6))
WINDOW = 13
SIMILARITY = 0.8
#: Benchmark starts whose hashes are broadcast at a time: some 16 bytes each.
BLOCK_STARTS = 1_000_000
MOST_BLOCKS = 8

Mask = tuple[int, ...]


def may_differ(length: int, similarity: float = SIMILARITY) -> int:
    """Tokens of a window of `length` that may differ."""
    return int(length * (1 - similarity) + 1e-9)


def short_masks(length: int, similarity: float = SIMILARITY) -> list[Mask]:
    """Masks over a whole item: its positions are dealt to a few classes, and each mask leaves out as many classes as
    tokens may differ, so one of them leaves out all that do."""
    k = may_differ(length, similarity)
    classes = k and min(length, k + 2)
    left_out = combinations(range(classes), k) if k else [()]
    return [tuple(p for p in range(length) if not k or p % classes not in out) for out in left_out]


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _keys(rows: DataFrame, tokens_col: str, masks: dict[int, Mask], first: int, *keep: str) -> DataFrame:
    """A row for each start from `first` on (negative: before the text) and mask that fits: key, at, the columns `keep`
    and the tokens. Plain generators and hashes of array elements: all of it is compiled, and the tokens are pointed
    to, not copied."""
    size = F.size(tokens_col)
    least = 1 + min(m[-1] for m in masks.values())
    # No filter on the size: it would make the tokens twice.
    rows = rows.select(*keep, tokens_col, F.explode(F.when(size - least >= first, F.sequence(F.lit(first), size - least))).alias("at"))
    keys = []
    for k, m in masks.items():
        inside = F.col("at") + m[-1] < size
        if first + m[0] < 0:
            inside = inside & (F.col("at") + m[0] >= 0)
        keys.append(F.when(inside, F.xxhash64(F.lit(k), *(F.get(tokens_col, F.col("at") + p) for p in m))))
    return rows.select(*keep, tokens_col, "at", F.explode(F.array(*keys)).alias("key")).where("key is not null")


def _items(bench: DataFrame, id_col: str, text_col: str) -> DataFrame:
    items = bench.select(F.col(id_col).alias("item_id"), tokens(F.col(text_col).cast("string")).alias("item"))
    return items.withColumns({"len": F.size("item"), "of": F.xxhash64("item")}).where("len > 0").distinct()


def _best(agree: Column, size: Column, window: int) -> Column:
    """The most agreeing places in any run of min(size, window) places."""
    width = F.least(size, F.lit(window))
    runs = F.transform(F.sequence(F.lit(1), size - width + 1), lambda i: F.aggregate(F.slice(agree, i, width), F.lit(0), lambda a, x: a + x))
    return F.array_max(runs)


def overlaps(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", masks: tuple[tuple[int, ...], ...] = MASKS, window: int = WINDOW, similarity: float = SIMILARITY, block_starts: int = BLOCK_STARTS, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """(id, item_id, start, agreeing, window): each item found in each document, where it would begin there (in
    tokens, negative where the document lacks its head), and the agreeing tokens of its best window."""
    items = _items(bench, item_col, item_text_col)
    lengths = {r["len"]: r["n"] for r in items.groupBy(F.least("len", F.lit(window)).alias("len")).agg(F.sum("len").alias("n")).collect()}  # `window` rows at most
    # A number for each mask in use, and the item keys of each length: every start of a long item, the one of a short.
    numbered: dict[int, Mask] = dict(enumerate(masks)) if window in lengths else {}
    arms: list[tuple[Column, dict[int, Mask]]] = [(F.col("len") >= window, dict(numbered))] if numbered else []
    overhang = 0
    for n in sorted(k for k in lengths if k < window):
        own = {len(masks) + 100 * n + j: m for j, m in enumerate(short_masks(n, similarity))}
        numbered |= own
        arms.append((F.col("len") == n, own))
        overhang = max(overhang, may_differ(n, similarity))
    docs_with = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("sum"), tokens(F.col(text_col).cast("string")).alias("w"))
    if not numbered:
        none = T.StructType([docs_with.schema["id"], items.schema["item_id"], *(T.StructField(c, T.IntegerType()) for c in ("start", "agreeing", "window"))])
        return docs.sparkSession.createDataFrame([], none)
    starts = _keys(docs_with, "w", numbered, -overhang, "id", "sum")
    blocks = max(1, -(-sum(n * len(masks) if k == window else n for k, n in lengths.items()) // block_starts))
    piece = F.slice("w", F.greatest(F.col("start"), F.lit(0)) + 1, F.col("len")).alias("piece")

    def item_keys(some: DataFrame) -> DataFrame:
        found = []
        for which, own in arms:
            short = [m for k, m in own.items() if k >= len(masks)]
            made = _keys(some.where(which), "item", own, 0, "item_id", "of", "len")
            found.append(made.where("at = 0") if short else made)
        return reduce(DataFrame.unionByName, found).select("key", "item_id", "of", "len", F.col("at").alias("from"))

    if blocks <= most_blocks:
        hits = []
        for block in range(blocks):
            keys = item_keys(items.where(F.pmod("of", F.lit(blocks)) == block))
            met = starts.join(F.broadcast(keys), "key").withColumn("start", F.col("at") - F.col("from"))
            hits.append(met.select("id", "item_id", "of", "start", piece))
        hits = reduce(DataFrame.unionByName, hits).distinct()
    else:
        met = starts.select("id", "sum", "at", "key").join(item_keys(items), "key")
        met = met.select(F.col("id").alias("d"), F.col("sum").alias("s"), "item_id", "of", "len", (F.col("at") - F.col("from")).alias("start")).distinct()
        hits = docs_with.join(met, F.col("id").eqNullSafe(F.col("d")) & F.col("sum").eqNullSafe(F.col("s"))).select("id", "item_id", "of", "start", piece).distinct()
    # Distinct placements first, the items' tokens and the comparison after: compared inside the join with the hashes,
    # every start would have to carry a copy of its document.
    named = items.select(F.col("item_id").alias("named"), F.col("of").alias("text"), "item", "len")
    hits = hits.join(named, (F.col("of") == F.col("text")) & F.col("item_id").eqNullSafe(F.col("named")))
    # The item's places that lie before or behind the document agree with nothing.
    laid = F.concat(F.array_repeat(F.lit(None).cast("string"), F.greatest(-F.col("start"), F.lit(0))), F.col("piece"))
    agree = F.zip_with("item", F.slice(laid, F.lit(1), F.col("len")), lambda a, b: F.coalesce(a == b, F.lit(False)).cast("int"))
    hits = hits.select("id", "item_id", "start", "len", agree.alias("agree"))
    hits = hits.select("id", "item_id", "start", _best(F.col("agree"), F.col("len"), window).alias("agreeing"), F.least("len", F.lit(window)).alias("window"))

    hits = hits.where(F.col("agreeing") >= F.ceil(F.col("window") * F.lit(similarity) - 1e-9))
    best = hits.groupBy("id", "item_id").agg(F.min(F.struct((-F.col("agreeing")).alias("n"), "start", "window")).alias("best"))
    return best.select("id", "item_id", F.col("best.start").alias("start"), (-F.col("best.n")).alias("agreeing"), F.col("best.window").alias("window"))


def clean(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """docs without the rows in whose texts an item is found. Each row is judged by its own text: rows that share an id,
    a null one too, don't go for one another."""
    row = F.struct(docs[id_col].alias("id"), F.xxhash64(docs[text_col].cast("string")).alias("sum"))
    found = overlaps(docs.select(row.alias("row"), docs[text_col].alias("text")), bench, "row", "text", **more)
    found = found.select(F.col("id.id").alias("__perigee_id"), F.col("id.sum").alias("__perigee_sum")).distinct()
    same = docs[id_col].eqNullSafe(F.col("__perigee_id")) & (F.xxhash64(docs[text_col].cast("string")) == F.col("__perigee_sum"))
    return docs.join(found, same, "left_anti")
