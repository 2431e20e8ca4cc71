import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from perigee.llm import simhash
from perigee.llm.common import connected_components


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def slow_components(fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprints_and_components_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = spark.createDataFrame([(10_000, None), (10_001, ""), (10_002, " \n"), (10_003, "Ä B"), (10_004, "ä b"), (10_005, "one two"), (10_006, "x " * 40_000), (10_006, "x " * 40_000)], "doc_id long, text string")
    docs = docs.select("doc_id", "text").union(extra).withColumn("fp", F.lit("clash"))
    rows = sorted(simhash.simhash_groups(docs).collect(), key=lambda r: r.id)
    texts = {r.doc_id: r.text for r in docs.collect()}
    fps = [slow_fingerprint(texts[r.id]) for r in rows]
    assert [r.fp % 2**64 for r in rows] == fps
    assert [r.component_id for r in rows] == [rows[i].id for i in slow_components(fps)]


def test_links_over_many_tiles(spark):
    rng = random.Random(5)
    fps = {0}
    for _ in range(40):
        base = rng.getrandbits(64)
        for _ in range(12):
            base ^= sum(1 << rng.randrange(64) for _ in range(rng.choice((1, 2, 3, 5))))
            fps.add(base % 2**64)
    fps |= {rng.getrandbits(64) for _ in range(800)}
    fps = sorted(fps)
    signed = [int(np.uint64(x).view(np.int64)) for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {r.node: r.root for r in connected_components(simhash.links(df, tile=16)).collect()}
    want = slow_components(fps)
    groups = {}
    for x, w in zip(signed, want, strict=True):
        groups.setdefault(w, set()).add(got.get(x, x))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_components_of_a_chain_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 160)] + [(7, 7), (3, 2)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_one_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "A b c d"), (3, "other words here now"), (None, "a b c d"), (3, "other words here now"), (3, "quite another text with the same id"), (None, "z"), (None, "z"), (None, "y")], "doc_id long, text string").withColumn("sum", F.lit(1))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == [("1", "a b c d"), ("3", "other words here now"), ("3", "quite another text with the same id"), ("None", "y"), ("None", "z")]
    assert simhash.simhash_groups(docs.limit(0)).count() == 0


def slow_shingles(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def slow_similar(sets):
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] == sets[j] or sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def test_a_large_group_of_small_or_similar_sets_gives_no_pairs(spark):
    base = [f"w{k}" for k in range(400)]
    texts = [" ".join(base[:k] + [f"x{k}"] + base[k + 1 :]) for k in range(0, 390, 2)]
    texts += [f"one two three four five six seven eight {k}" for k in range(500)] + ["one two three four five six seven eight"]
    texts += [f"a b c d e f g h i j k l m{k}" for k in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = simhash.shingle_sets(docs, "doc_id", "text", 5).withColumn("label", F.col("sig"))
    assert simhash.small_links(sets, 0.8).count() <= 2 * 802
    assert simhash.similar_candidates(sets, 0.8, simhash.RADII[0], True).count() < 1000
    rows = sorted(simhash.similar_groups(docs).collect(), key=lambda r: r.id)
    seen = {}
    assert [seen.setdefault(r.root, r.id) for r in rows] == slow_similar([slow_shingles(t) for t in texts])


def test_groups_by_similarity_match_brute_force(spark):
    rng = random.Random(8)
    texts = ["", None, " \n", "one", "One", "one two three four five", "one two three four five six"]
    for n in (5, 8, 9, 10, 11, 12, 13, 14, 15, 24, 60, 200, 900):
        for _ in range(6):
            words = [f"w{rng.randrange(5000)}" for _ in range(n)]
            texts.append(" ".join(words))
            for _ in range(6):
                new = list(words)
                for _ in range(rng.randrange(max(2, n // 30) + 1)):
                    at, what = rng.randrange(len(new)), rng.randrange(3)
                    new[at : at + (what > 0)] = ["x"] if what < 2 else []
                new = new + ["y"] * rng.choice((0, 0, 1, 2))
                words = new if rng.random() < 0.5 else words
                texts.append(" ".join(new))
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [slow_shingles(t) for t in texts]
    want = slow_similar(sets)
    for tile, block in ((32_768, 10**6), (40, 60)):
        rows = sorted(simhash.similar_groups(docs, tile=tile, block=block).collect(), key=lambda r: r.id)
        seen = {}
        assert [seen.setdefault(r.root, r.id) for r in rows] == want
    # Most of these links differ in more than three bits of the thin query's fingerprints.
    assert len(set(slow_components([slow_fingerprint(t) for t in texts]))) > len(set(want))
    kept = simhash.keep_one(docs, size=5, similarity=0.8)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want))
    assert simhash.similar_groups(docs.limit(0)).count() == 0
