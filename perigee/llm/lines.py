"""Line dedup by a deletion-neighbourhood join over words.

The unit of an edit is a word: two lines are near copies if one becomes the other by inserting, deleting or
replacing one word, and the longer has at least five words (so four fifths of it agree); lines that are equal
word for word are exact copies. An occurrence is dropped if an earlier occurrence of an equal line exists, or an
earlier line (the first occurrence of its text) is a near copy. Chains count: the earlier line keeps its power to
drop others even where it is dropped itself. Earlier means a smaller (doc_id, line number).

Only DataFrame expressions are used. Steps: hash each line's words and find each distinct line's first place; keep
lines that share their first or last half with another line of about their length (a line within one edit always
does); for those, emit all variants with at most one word left out as hashed keys; name each variant its key's earliest
line, so a group of thousands of copies gives one witness a key and never its pairs; verify the edit distance of each
witness on the words themselves. Distinct lines have a number, which stands for their hashes while variants are dealt.

Keys: a word's hash is salted with its position, and a line's hash is the exclusive-or of them. Leaving word i out
without closing the gap finds replacements; closing it (what follows moves by one) finds insertions and deletions.

Defined results: lines are split at line feeds, words at blanks, tabs, carriage returns and form feeds; a line
without words is never dropped; a null text has no lines and stays null; a null doc_id sorts before all others;
rows with the same doc_id share their places, so repeated rows keep and lose the same lines. Other columns,
whatever their names, pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perigee.llm.common import materialize

MIN_WORDS = 5
#: Words that are hashed together in one step of a running exclusive-or.
BLOCK = 1 << 7


def normal(line: Column) -> Column:
    """The line's words joined by one blank. Most lines are so already, which plain byte searches tell."""
    odd = F.lit(False)
    for mark in ("  ", "\t", "\r", "\u000b", "\u000c"):
        odd = odd | F.contains(line, F.lit(mark))
    words = F.array_remove(F.split(F.translate(line, "\t\r\u000b\u000c", "    "), " "), "")
    return F.when(odd | F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" ")), F.array_join(words, " ")).otherwise(line)


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    lines = docs.select(F.col(id_col).alias("d"), F.posexplode(F.split(F.col(text_col).cast("string"), "\n")).alias("n", "line"))
    lines = lines.select("d", "n", normal(F.col("line")).alias("s")).where("s <> ''")
    return lines.select("d", "n", "s", F.xxhash64("s").alias("i1"), F.xxhash64(F.lit(7), "s").alias("i2"))


def _halves(s: Column, size: Column) -> list[Column]:
    """Hashes that a line shares with every line within one edit: two overlapping classes of lengths, and in each
    the first and the last half of the words that every line of the class has."""
    found = []
    for turn in (0, 4):
        least = F.greatest(F.lit(0), (F.shiftright(size + turn, 3) * 8 - turn))
        half = F.shiftright(F.greatest(F.lit(MIN_WORDS - 1), least), 1)
        found += [F.xxhash64(F.lit(turn), least, F.call_function("substring_index", s, F.lit(" "), half)), F.xxhash64(F.lit(turn + 1), least, F.call_function("substring_index", s, F.lit(" "), -half))]
    return found


def _variants(near: DataFrame) -> DataFrame:
    """A row for each variant: key, closed (a word was left out and the gap closed; all others compare with any)."""
    rows = near.select("line", "first", "len", "w", F.aggregate(F.transform("w", lambda w, i: F.xxhash64(w, i)), F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x)).alias("all"))
    # upto[i]: exclusive-or, over the words up to and with i, of a word's hashes at its place and one before it; made
    # block by block, so that the arrays that grow stay short.
    moved = F.transform("w", lambda w, i: F.xxhash64(w, i).bitwiseXOR(F.xxhash64(w, i - 1)))
    rows = rows.withColumn("m", moved)
    blocks = F.transform(F.sequence(F.lit(0), F.shiftright(F.col("len") - 1, 7)), lambda k: F.slice("m", k * BLOCK + 1, F.lit(BLOCK)))
    run = lambda part: F.aggregate(part, F.array(F.lit(0).cast("long")), lambda acc, x: F.array_append(acc, F.element_at(acc, -1).bitwiseXOR(x)))
    rows = rows.withColumn("runs", F.transform(blocks, run)).withColumn("before", run(F.transform("runs", lambda r: F.element_at(r, -1))))
    holes = rows.select("line", "first", "len", "all", "w", "runs", "before", F.explode(F.sequence(F.lit(-1), F.col("len") - 1)).alias("i"))
    own = F.xxhash64(F.get("w", F.col("i")), "i")
    block = F.shiftright("i", 7)
    upto = F.get("before", block).bitwiseXOR(F.get(F.get("runs", block), F.col("i") - block * BLOCK + 1))
    hole = F.col("all").bitwiseXOR(own)
    closed = hole.bitwiseXOR(F.element_at("before", -1)).bitwiseXOR(upto)
    # Place -1 stands for the whole line.
    keys = F.when(F.col("i") < 0, F.array(F.xxhash64(F.lit("d"), "len", "all"))).otherwise(F.array(F.xxhash64(F.lit("s"), "len", "i", hole), F.xxhash64(F.lit("d"), F.col("len") - 1, closed)))
    out = holes.select("line", "first", F.posexplode(keys).alias("x", "key"))
    return out.select("line", "first", "key", (F.col("x") == 1).alias("closed")).where("key is not null")


def _within_one(a: Column, b: Column) -> Column:
    """Whether the word lists differ by exactly one inserted, deleted or replaced word."""
    long = F.when(F.size(a) >= F.size(b), a).otherwise(b)
    short = F.when(F.size(a) >= F.size(b), b).otherwise(a)
    differ = F.zip_with(F.slice(long, F.lit(1), F.size(short)), short, lambda x, y: x != y)
    at = F.array_position(differ, F.lit(True)).cast("int")  # 0: one begins with the other
    rest = F.when(at == 0, F.size(long) - F.size(short) == 1)
    rest = rest.when(F.size(long) == F.size(short), F.slice(long, at + 1, F.size(long)) == F.slice(short, at + 1, F.size(short)))
    return rest.otherwise((F.size(long) - F.size(short) == 1) & (F.slice(long, at + 1, F.size(long)) == F.slice(short, at, F.size(short))))


def _dropped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of `dropped_lines`, repeated where rows share an id."""
    lines = _lines(docs, id_col, text_col)
    size = F.octet_length("s") - F.octet_length(F.replace(F.col("s"), F.lit(" "), F.lit(""))) + 1
    sized = lines.withColumn("len", size)
    halves = [h.alias(f"h{k}") for k, h in enumerate(_halves(F.col("s"), F.col("len")))]
    sized = sized.select("d", "n", "i1", "i2", "len", *halves)
    distinct = sized.groupBy("i1", "i2").agg(F.min(F.struct("d", "n")).alias("first"), F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("len", "h0", "h1", "h2", "h3")))
    # The number is written with the line, so all that reads the table sees the same.
    distinct = materialize(distinct.withColumn("line", F.monotonically_increasing_id()))

    halves = distinct.where(F.col("len") >= MIN_WORDS - 1).select("line", F.explode(F.array("h0", "h1", "h2", "h3")).alias("key")).where("key is not null")
    # What rows are joined with by a key that may be frequent is written before: such a join can be split. These tables
    # grow with the input, so they are never broadcast, not even where they are still small.
    shared = materialize(halves.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"))
    able = halves.join(shared.hint("merge"), "key", "left_semi").select("line").distinct()
    # Written, so that the shuffles of halves are gone when texts are shuffled.
    able = materialize(distinct.join(able, "line", "left_semi").select("line", F.col("i1").alias("j1"), F.col("i2").alias("j2"), "first"))
    # Their words, from the document that has them first: a document's list is no longer than the document.
    places = able.groupBy(F.col("first.d").alias("at")).agg(F.collect_list(F.struct(F.col("first.n").alias("n"), "line", "j1", "j2")).alias("at_lines"))
    texts = docs.select(F.col(id_col).alias("d"), F.col(text_col).cast("string").alias("text"))
    # The split stands below the explode: one for each document, not one for each of its lines.
    near = texts.join(places, F.col("d").eqNullSafe(F.col("at"))).select("d", F.split("text", "\n").alias("lines"), "at_lines")
    near = near.select("d", "lines", F.explode("at_lines").alias("p"))
    near = near.select(F.struct("d", F.col("p.n").alias("n")).alias("first"), "p.line", "p.j1", "p.j2", normal(F.get("lines", F.col("p.n"))).alias("s"))
    near = near.where((F.xxhash64("s") == F.col("j1")) & (F.xxhash64(F.lit(7), "s") == F.col("j2"))).withColumn("w", F.split("s", " "))
    near = materialize(near.select("line", "first", "w", F.size("w").alias("len")).dropDuplicates(["line"]))

    # A window, as a join of the variants with their minima would make and deal them twice. Dealt before it, without the
    # structs that it compares.
    least = lambda closed: F.min(F.when(F.col("closed") == closed, F.struct("first", "line"))).over(Window.partitionBy("key"))
    variants = _variants(near).repartition("key").select("line", "first", "closed", least(False).alias("y"), least(True).alias("x"))
    # A replaced word: any member of the key. A closed gap: the whole line that it equals, or the earliest longer one.
    witness = F.when(F.col("closed"), F.col("y")).when(F.col("y.first") < F.col("first"), F.col("y")).otherwise(F.col("x"))
    hits = variants.withColumn("by", witness).where(F.col("by.first") < F.col("first"))
    hits = hits.groupBy("line", F.col("by.line").alias("k")).agg(F.min("by.first").alias("by"))
    words = near.select(F.col("line").alias("k"), F.col("w").alias("kw"))
    checked = hits.join(near.select("line", "w"), "line").join(words, "k")
    checked = checked.where((F.greatest(F.size("w"), F.size("kw")) >= MIN_WORDS) & _within_one(F.col("w"), F.col("kw")))
    keeper = materialize(checked.groupBy("line").agg(F.min("by").alias("by")))

    marked = distinct.join(keeper.hint("merge"), "line", "left").where("n > 1 or by is not null")
    marked = materialize(marked.select(F.col("i1").alias("k1"), F.col("i2").alias("k2"), "first", "by"))
    own = F.struct("d", "n")
    out = lines.select("d", "n", "i1", "i2").join(marked.hint("merge"), (F.col("i1") == F.col("k1")) & (F.col("i2") == F.col("k2")))
    out = out.where(F.col("by").isNotNull() | (own > F.col("first")))
    kept = F.coalesce("by", "first")
    return out.select(F.col("d").alias("id"), F.col("n").alias("line_no"), kept["d"].alias("kept_id"), kept["n"].alias("kept_line_no"), F.col("by").isNotNull().cast("int").alias("edits"), F.col("i1").alias("line_hash"))


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line_no, kept_id, kept_line_no, edits, line_hash): every occurrence to drop, with the earliest line that drops it
    (line_no counts from 0; edits is 0 for an exact copy, 1 for a near copy, which goes first if it is earlier)."""
    # Dealt anew by place: by the lines' hashes, as the join leaves them, all copies of a line would stay in one task.
    return _dropped(docs, id_col, text_col).repartition("id", "line_no").distinct()


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """docs without the dropped lines, all columns and rows as they were but the text (and `count_col`, its length).

    A text all of whose lines are dropped becomes empty; its row stays.
    """
    gone = _dropped(docs, id_col, text_col).groupBy(F.col("id").alias("__perigee_id")).agg(F.collect_list(F.struct("line_no", "line_hash")).alias("__perigee_gone"))
    both = docs.join(gone, docs[id_col].eqNullSafe(F.col("__perigee_id")), "left").withColumn("__perigee_lines", F.split(docs[text_col].cast("string"), "\n"))
    # Another row with the same id may have another line there.
    own = F.filter("__perigee_gone", lambda g: F.xxhash64(normal(F.get("__perigee_lines", g["line_no"]))) == g["line_hash"])
    left = F.array_except(F.sequence(F.lit(0), F.size("__perigee_lines") - 1), F.transform(own, lambda g: g["line_no"]))
    left = F.transform(left, lambda n: F.get("__perigee_lines", n))
    text = F.when(F.col("__perigee_gone").isNull(), docs[text_col]).otherwise(F.array_join(left, "\n"))
    new = {text_col: text}
    if count_col:
        new[count_col] = F.when(F.col("__perigee_gone").isNull(), docs[count_col]).otherwise(F.length(text))
    return both.select(*(new[c].alias(c) if c in new else docs[c] for c in docs.columns))
