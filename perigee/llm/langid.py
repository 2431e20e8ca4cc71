"""Language identification of web pages by Bayesian evidence fusion.

Evidence for a page's language: (1) its visible text, by a naive Bayes model of character trigrams, hashed, whose
counts by language come from all labelled texts; its log likelihood counts `weight`-fold, as trigrams overlap;
(2) the language that its markup declares, by the share of declared values among the pages that read as each
language; (3) its address: the host's prior, from what the other pages of the host read as, smoothed towards that of
the address suffix (the host's last label), which is smoothed towards that of all pages, each prior counting as
`strength` pages. The posterior is their product, normalised.

The first reading is by text alone; everything else is grouped counts of it. Hosts join their counts by host, one row
a host. The trigram model (languages x 65,536) and the table of declarations (languages x languages + 2) are bounded
and go to all workers.

Pages and texts are read whole, each in one walk forward whatever stands in it.

Defined results: a null or empty page has no text evidence and no reading of its own, so its address and declaration
decide; a null url, or one without a host, shares the empty host; a declared value that no labelled text has counts as
"other", none as "none"; ties go to the language first in order; repeated rows are judged alike and count as pages of
their host; a null id is passed through; other columns are ignored. Without labelled texts every lang is null.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perigee.llm.common import materialize

SIZE = 1 << 16
CHUNK = 1 << 20
_OPEN = re.compile(r"<(?:!--|(script|style|nav|template|noscript)\b|[^>]*>)", re.I)
_END = {name: re.compile(rf"</{name}\s*+>", re.I) for name in ("script", "style", "nav", "template", "noscript")} | {"": re.compile("-->")}
_CLOSE = re.compile(">")
_HTML = re.compile(r"<html\b[^>]*", re.I)
_LANG = re.compile(r"\blang\s*+=\s*+(?:[\"']\s*+)?([A-Za-z]+)", re.I)
_MARKS = re.compile(r"[\W\d_]+")


def visible(page: str | None) -> str:
    """A page's text: without comments, tags, and what stands in elements that are not read. One walk forward: an end
    that was once looked for in vain is not looked for again, so a page's time grows with its length alone."""
    page = page or ""
    out, at, absent = [], 0, set()
    last = page.rfind(">")  # behind it no tag ends
    while found := _OPEN.search(page, at, last + 1):
        name = (found[1] or "").lower()
        unread, end = name or found[0] == "<!--", None
        if unread and name not in absent:
            end = _END[name].search(page, found.end())
            if end is None:
                absent.add(name)
        if end is None and unread:  # an element without an end hides only its tag, a comment without one is a tag
            end = _CLOSE.search(page, found.start())
        out.append(page[at : found.start()])
        at = end.end() if end else found.end()
    out.append(page[at:])
    return entities.unescape(" ".join(out))


def declared(page: str | None) -> str | None:
    # Tag by tag over the whole page: each character is in one tag, so long pages take linear time.
    for tag in _HTML.finditer(page or ""):
        if found := _LANG.search(tag[0], 5):
            return found[1].lower()
    return None


def trigrams(text: str) -> Iterator[np.ndarray]:
    """Hashes of the character trigrams of a text's words with their borders."""
    words = f" {_MARKS.sub(' ', text.lower()).strip()} "
    if len(words) < 3:
        return
    for at in range(0, len(words) - 2, CHUNK):
        c = np.frombuffer(words[at : at + CHUNK + 2].encode("utf-32-le"), dtype="<u4")
        mixed = (c[:-2] * np.uint32(0x9E3779B1) ^ c[1:-1] * np.uint32(0x85EBCA77)) + c[2:] * np.uint32(0xC2B2AE3D)
        yield (mixed * np.uint32(0x27D4EB2F) >> np.uint32(16)).astype(np.int64)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order, and their log probabilities of the hashed trigrams, over all texts with a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = sums.setdefault(lang, np.zeros(SIZE, dtype=np.int64))
                for found in trigrams(text.as_py()):
                    own += np.bincount(found, minlength=SIZE)
        for lang, n in sums.items():
            at = np.nonzero(n)[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])], names=["lang", "gram", "n"])

    known = docs.select(F.lower(F.col(lang_col)).alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and lang <> '' and text is not null")
    rows = known.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(rows.column("lang").to_pylist()))
    counts = np.zeros((len(langs), SIZE))
    which = {lang: k for k, lang in enumerate(langs)}
    counts[[which[x] for x in rows.column("lang").to_pylist()], rows.column("gram").to_numpy()] = rows.column("n").to_numpy()
    return langs, np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * SIZE)) if langs else counts


def read(pages: DataFrame, langs: list[str], logp: np.ndarray, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(id, host, suffix, declared, ll, n): log likelihoods by language, of n trigrams."""
    schema = T.StructType([pages.select(F.col(id_col).alias("id")).schema[0], *(T.StructField(c, T.StringType()) for c in ("host", "suffix", "declared")), T.StructField("ll", T.ArrayType(T.DoubleType())), T.StructField("n", T.LongType())])
    table = np.ascontiguousarray(logp.T)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said, ll, n = [], [], []
            for cell in batch.column(3):
                page = cell.as_py()
                d = declared(page)
                said.append("none" if d is None else d if d in langs else "other")
                total, size = np.zeros(len(langs)), 0
                for found in trigrams(visible(page)):
                    for at in range(0, len(found), 4096):
                        total += table[found[at : at + 4096]].sum(axis=0)
                    size += len(found)
                ll.append(total.tolist())
                n.append(size)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(said, pa.string()), pa.array(ll, pa.list_(pa.float64())), pa.array(n, pa.int64())], names=[f.name for f in schema])

    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return pages.select(F.col(id_col).alias("id"), host.alias("host"), F.substring_index(host, ".", -1).alias("suffix"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, schema)


def _best(array: Column) -> Column:
    """Place (from 1) of the largest value, the first of equals."""
    return F.array_position(array, F.array_max(array)).cast("int")


def identify(pages: DataFrame, docs: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", text_col: str = "text", lang_col: str = "lang", weight: float = 0.1, strength: float = 10.0) -> DataFrame:
    """(id, lang, posterior, text_lang, declared, host) of every row of pages; docs are the labelled texts."""
    langs, logp = train(docs, text_col, lang_col)
    if not langs:
        none = F.lit(None).cast("string")
        empty = read(pages, langs, logp, id_col, url_col, html_col)
        return empty.select("id", none.alias("lang"), F.lit(None).cast("double").alias("posterior"), none.alias("text_lang"), "declared", "host")
    k = len(langs)
    rows = read(pages, langs, logp, id_col, url_col, html_col).withColumn("ll", F.transform("ll", lambda x: x * weight))
    rows = materialize(rows.withColumn("guess", F.when(F.col("n") > 0, _best(F.col("ll")))))

    counts = [F.count_if(F.col("guess") == g + 1).cast("double") for g in range(k)]
    said: dict[tuple[str, int], int] = {(r["declared"], r["guess"]): r["n"] for r in rows.where("guess is not null").groupBy("declared", "guess").agg(F.count("*").alias("n")).collect()}
    values = [*langs, "other", "none"]
    total = [sum(said.get((v, g + 1), 0) for v in values) for g in range(k)]
    # A declared value is as likely as among the pages that read so; one page's worth of the true one is added before.
    odds = {v: [math.log((said.get((v, g + 1), 0) + (0.5 if v == langs[g] else 0) + 0.5 / len(values)) / (total[g] + 1)) for g in range(k)] for v in values}
    corpus = [(n + 1) / (sum(total) + k) for n in total]

    # Written before they are joined: the pages of a frequent host, and the hosts of a frequent suffix, can be split.
    suffixes = materialize(rows.groupBy("suffix").agg(F.array(*counts).alias("of_suffix")))
    hosts = materialize(rows.groupBy("host", "suffix").agg(F.array(*counts).alias("of_host")))
    hosts = materialize(hosts.join(suffixes, "suffix").drop("suffix").withColumnRenamed("host", "h"))
    joined = rows.join(hosts, F.col("host") == F.col("h"))
    others = lambda c: F.transform(c, lambda x, i: x - F.when(F.col("guess") == i + 1, 1.0).otherwise(0.0))  # noqa: E731  the page itself doesn't count
    smooth = lambda own, prior: F.zip_with(own, prior, lambda x, p: (x + strength * p) / (F.aggregate(own, F.lit(0.0), lambda a, y: a + y) + strength))
    joined = joined.withColumn("s", others("of_suffix")).withColumn("o", others("of_host"))
    joined = joined.withColumn("p_suffix", smooth(F.col("s"), F.array(*map(F.lit, corpus)))).withColumn("prior", smooth(F.col("o"), F.col("p_suffix")))
    says = F.lit(None).cast("array<double>")
    for v in values:
        says = F.when(F.col("declared") == v, F.array(*map(F.lit, odds[v]))).otherwise(says)
    joined = joined.withColumn("says", says).withColumn("log", F.zip_with(F.zip_with("ll", "says", lambda a, b: a + b), "prior", lambda a, p: a + F.log(p)))
    joined = joined.withColumn("top", F.array_max("log")).withColumn("sum", F.aggregate("log", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top"))))
    name = lambda at: F.element_at(F.array(*map(F.lit, langs)), at)
    return joined.select("id", name(_best(F.col("log"))).alias("lang"), (1 / F.col("sum")).alias("posterior"), F.when(F.col("guess").isNotNull(), name(F.col("guess"))).alias("text_lang"), "declared", "host")
