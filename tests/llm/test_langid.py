import html
import math
import re
import time
import unicodedata
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from perigee.llm import langid
from perigee.llm.queries import op5_language_id

SF = "/root/testdata/sf0.01"


def test_query_reads_every_page(spark):
    rows = op5_language_id(spark, SF).collect()
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(rows) == len(pages) and all(0 < r.posterior <= 1 + 1e-9 for r in rows)
    said = {i: re.search('lang="([a-z]+)"', p.html)[1] for i, p in pages.items()}
    assert np.mean([r.lang == said[r.page_id] for r in rows]) > 0.97


def own_trigrams(text):
    """Hashes of character trigrams, one by one in whole numbers of 32 bits."""
    words = "".join(c if c.isalpha() or unicodedata.category(c) in ("Mn", "Mc", "Nl", "No") and re.match(r"\w", c) and not c.isdigit() else " " for c in text.lower()).split()
    chars = [ord(c) for c in " " + " ".join(words) + " "] if words else []
    for a, b, c in zip(chars, chars[1:], chars[2:], strict=False):
        x = ((a * 0x9E3779B1 % 2**32) ^ (b * 0x85EBCA77 % 2**32)) + c * 0xC2B2AE3D
        yield x % 2**32 * 0x27D4EB2F % 2**32 >> 16


def own_visible(page):
    """Character by character: what is not in a comment, a tag or an element that is not read."""
    page, out, i = page or "", [], 0
    while i < len(page):
        if page[i] != "<" or ">" not in page[i:]:
            out.append(page[i])
            i += 1
            continue
        name = next((n for n in ("script", "style", "nav", "template", "noscript") if page[i + 1 : i + 1 + len(n)].lower() == n and not page[i + 1 + len(n) : i + 2 + len(n)].isalnum()), None)
        to = page.index(">", i) + 1
        if page.startswith("<!--", i) and "-->" in page[i + 4 :]:
            to = page.index("-->", i + 4) + 3
        elif name and (m := re.search(rf"</{name}\s*>", page[i:], re.I)):
            to = i + m.end()
        out.append(" ")
        i = to
    return html.unescape("".join(out))


def own_declared(page):
    for tag in (page or "").lower().split("<html")[1:]:
        words = tag.split(">")[0].replace("=", " = ").split()
        for a, b, c in zip(words, words[1:], words[2:], strict=False):
            if a == "lang" and b == "=" and tag[:1] in (" ", "\n"):
                if m := re.match(r"[a-z]+", c.strip("'\"")):
                    return m[0]
    return None


def brute(pages, docs, weight=0.1, strength=10.0):
    counts = {}
    for lang, text in docs:
        if lang and text is not None:
            counts.setdefault(lang.lower(), Counter()).update(own_trigrams(text))
    langs = sorted(counts)
    rows = []
    for i, url, page in pages:
        grams = list(own_trigrams(own_visible(page)))
        ll = [weight * sum(math.log((counts[x][g] + 0.5) / (sum(counts[x].values()) + 0.5 * 65_536)) for g in grams) for x in langs]
        d = own_declared(page)
        m = re.search(r"://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
        host = m[1].lower() if m else ""
        rows.append((i, host, host.rsplit(".", 1)[-1], "none" if d is None else d if d in langs else "other", ll, ll.index(max(ll)) if grams else None))
    k, out = len(langs), []
    values = [*langs, "other", "none"]
    reads = Counter((r[3], r[5]) for r in rows if r[5] is not None)
    total = [sum(reads[v, g] for v in values) for g in range(k)]
    for i, host, suffix, d, ll, guess in rows:
        own = lambda at, name: [sum(r[5] == g and r[at] == name for r in rows) - (guess == g) for g in range(k)]
        corpus = [(n + 1) / (sum(total) + k) for n in total]
        s, h = own(2, suffix), own(1, host)
        ps = [(x + strength * p) / (sum(s) + strength) for x, p in zip(s, corpus)]
        prior = [(x + strength * p) / (sum(h) + strength) for x, p in zip(h, ps)]
        log = [ll[g] + math.log((reads[d, g] + (0.5 if d == langs[g] else 0) + 0.5 / len(values)) / (total[g] + 1)) + math.log(prior[g]) for g in range(k)]
        z = sum(math.exp(x - max(log)) for x in log)
        out.append((str(i), langs[log.index(max(log))], round(1 / z, 8), None if guess is None else langs[guess], d, host))
    return sorted(out, key=str)


def test_fusion_matches_brute_force_on_odd_rows(spark):
    docs = [(r.lang, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()] + [(None, "x"), ("", "x"), ("en", None), ("EN", "the of and")]
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").limit(25).collect()]
    pages += [(None, None, None), (1000, "", ""), (1001, "http://x.de/", "<html lang='de'>"), (1002, "http://x.de/", "<html lang=zz><p>der die das und</p>"), (1002, "http://x.de/", "<html lang=zz><p>der die das und</p>"), (1003, "nohost", "<b>" + "the of and " * 3000), (1004, "http://u@X.FR:80/a", "<script>der die das</script><p>le la les et"), (1005, "http://y.fr", "1234 !!")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("h")).withColumn("n", F.lit(1))
    rows = langid.identify(df, spark.createDataFrame(docs, "lang string, text string")).collect()
    got = sorted(((str(r.id), r.lang, round(r.posterior, 8), r.text_lang, r.declared, r.host) for r in rows), key=str)
    for a, b in zip(got, brute(pages, docs), strict=True):
        assert a[:2] == b[:2] and a[3:] == b[3:] and abs(a[2] - b[2]) < 1e-6
    assert langid.identify(df.limit(0), spark.createDataFrame(docs, "lang string, text string")).count() == 0
    assert {r.lang for r in langid.identify(df, spark.createDataFrame([], "lang string, text string")).collect()} == {None}


def test_declarations_anywhere_in_a_page():
    for before in ("", "<!-- licence " + "x" * 5000 + " -->", " " * 5000):
        for inside in ("", " data-x='" + "y" * 5000 + "'"):
            assert langid.declared(f"{before}<HTML{inside} lang = 'de-AT'><p lang=fr>") == "de"
    assert langid.declared("<html><p lang=fr>") is None and langid.declared("<html a><html lang=es>") == "es"
    assert langid.declared("<html " * 200_000) is None


def test_odd_pages_take_linear_time():
    began = time.time()
    for page in ("<nav " * 200_000, "<nav " * 200_000 + ">", "<!-- " * 200_000 + ">", "<nav></na" * 100_000 + ">", "<html lang=" + " " * 1_000_000, "<" * 1_000_000 + ">", "</nav " + "<nav>" * 200_000, "<script>" + "x" * 1_000_000, "&" * 1_000_000, "<!-->" * 200_000):
        langid.visible(page)
        langid.declared(page)
    assert time.time() - began < 10


def test_visible_text():
    for page in ("a<b>c", "a<!-- <p> -->b<!--c>d", "<NAV x>menu</nav >text<navx>seen", "<script>a<b</script><style>p{}</style>z", "x < y", "<script>a</SCRIPT\n>b</script>", "<nav>open <p>one</p>", "a &amp; b", "", None, "<template>a<nav>b</template>c</nav>d"):
        assert langid.visible(page).split() == own_visible(page).split(), page
