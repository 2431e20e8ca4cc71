import math
import random
import re
from itertools import combinations

from pyspark.sql import functions as F

from perigee.llm import decontaminate as dc


def toks(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def brute(docs, items):
    out = {}
    for d, t in docs:
        w = toks(t)
        for i, v in ((i, toks(v)) for i, v in items):
            win = min(13, len(v))
            for start in range(-len(v), len(w)):
                a = [0 <= k + start < len(w) and w[k + start] == x for k, x in enumerate(v)]
                n = max((sum(a[k : k + win]) for k in range(len(v) - win + 1)), default=0)
                if v and n >= 0.8 * win and (n, -start) > (out.get((d, i), (0, 0))):
                    out[d, i] = (n, -start)
    return {k: (n, -s) for k, (n, s) in out.items()}


def test_masks_miss_no_two_differences_in_a_window():
    for differ in combinations(range(dc.WINDOW), 2):
        assert any(not {s + p for p in m} & set(differ) for m in dc.MASKS for s in range(dc.WINDOW - m[-1]))


def test_short_masks_miss_nothing_at_any_length():
    for n in range(1, dc.WINDOW):
        k = n - math.ceil(0.8 * n - 1e-9)
        assert dc.may_differ(n) == k and len(dc.short_masks(n)) <= 6
        for differ in combinations(range(n), k):
            assert any(not set(m) & set(differ) for m in dc.short_masks(n)), (n, differ)
        assert all(len(m) >= min(n, 3) for m in dc.short_masks(n))


def test_planted_passages_match_brute_force(spark):
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefghijklmnopqrst") * rng.choice((1, 2, 3, 4))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((1, 2, 3, 4, 5, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 20, 30, 36))] + [(None, " ".join(word() for _ in range(25)))]
    items += [(50, ""), (51, None), (52, "a a a a a a a a a a a a a a"), (53, "b b b b b b b"), (0, " ".join(word() for _ in range(6)))]
    docs = [(1000, None), (1001, ""), (1002, "a " * 400), (1003, "b " * 40), (None, items[16][1])]
    for d in range(160):
        _, item = items[rng.randrange(19)]
        v = item.split()
        cut = rng.choice((0, 0, 0, 1, -1, 2, -2, 4, -4))
        v = v[cut:] if cut >= 0 else v[:cut]
        v = [word() if rng.random() < rng.choice((0, 0.1, 0.2)) else x for x in v]
        v = [x.upper() + rng.choice(("", ",", ".")) for x in v]
        docs.append((d, " ".join([*(word() for _ in range(rng.choice((0, 3, 30)))), *v, *(word() for _ in range(rng.choice((0, 3, 30))))])))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item", F.lit(1)).withColumn("w", F.lit("x"))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("h", F.lit(0))
    want = brute(docs, items)
    assert {len(toks(dict(items)[i])) for _, i in want if i not in (0, None)} >= set(range(2, 14))
    for more in ({}, {"block_starts": 120}, {"block_starts": 120, "most_blocks": 0}):
        rows = dc.overlaps(df, bench, **more).collect()
        got = {(r.id, r.item_id): (r.agreeing, r.start) for r in rows}
        assert len(got) == len(rows) and got == want
    kept = dc.clean(df, bench)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {k[0] for k in got}
    assert dc.overlaps(df.limit(0), bench).count() == 0 and dc.overlaps(df, bench.limit(0)).count() == 0


def test_rows_that_share_an_id_are_judged_apart(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    docs = spark.createDataFrame([(None, f"see {item}"), (None, "a clean one"), (None, None), (1, item), (1, "clean too"), (2, "")], "doc_id long, text string")
    kept = dc.clean(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted((str(r.doc_id), r.text) for r in kept.collect() if r.text is not None) == [("1", "clean too"), ("2", ""), ("None", "a clean one")] and kept.count() == 4
