import random
import re
import time

from pyspark.sql import functions as F

from perigee.llm import common, lines


def words(line):
    return [w for w in re.split(r"[ \t\r\x0b\x0c]+", line) if w]


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or max(len(a), len(b)) < 5:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(docs):
    """{(id, line_no): ((kept id, kept line), edits)}; docs: (id, text); a null id sorts first."""
    key = lambda p: (p[0] is not None, p[0] or 0, p[1])
    first, all_ = {}, []
    for d, t in docs:
        for n, line in enumerate((t or "").split("\n") if t is not None else []):
            if w := tuple(words(line)):
                all_.append(((d, n), w))
                if w not in first or key((d, n)) < key(first[w]):
                    first[w] = (d, n)
    out = {}
    for p, w in all_:
        near = [f for v, f in first.items() if v != w and one_edit(v, w) and key(f) < key(first[w])]
        if near:
            out[p] = (min(near, key=key), 1)
        elif key(first[w]) < key(p):
            out[p] = (first[w], 0)
    return out


def run(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("d", F.lit(1)).withColumn("n", F.lit("clash"))
    rows = lines.dropped_lines(df).collect()
    got = {(r.id, r.line_no): ((r.kept_id, r.kept_line_no), r.edits) for r in rows}
    assert len(got) == len(rows)
    return df, got


def test_random_edits_match_brute_force(spark):
    rng = random.Random(11)
    docs, pool = [], []
    for d in range(60):
        text = []
        for _ in range(rng.randrange(6)):
            if pool and rng.random() < 0.7:
                line = list(rng.choice(pool))
                for _ in range(rng.choice((0, 1, 1, 2))):
                    at, what = rng.randrange(len(line) + 1), rng.randrange(3)
                    line[at : at + (what > 0)] = [rng.choice("abc")] if what < 2 else []
            else:
                line = [rng.choice("abc") for _ in range(rng.choice((1, 3, 4, 5, 6, 8, 12, 13, 40, 127, 128, 129, 260)))]
            pool.append(line)
            text.append(rng.choice(("", " ", "\t")) + rng.choice((" ", "  ", "\t")).join(line) + rng.choice(("", "\r")))
        docs.append((d, "\n".join(text)))
    _, got = run(spark, docs)
    want = brute(docs)
    assert got == want and sum(e for _, e in want.values()) > 20


def test_odd_rows_and_rewriting(spark):
    docs = [(None, "a b c d e"), (2, "a b c d e\nshort x\n\nshort x"), (3, None), (4, ""), (5, "a b c d f\r\nshort x\n \t"), (6, "q w e r t y"), (6, "q w e r t y"), (6, "q w e r t z\nk"), (7, "w " * 5000 + "z"), (8, "w " * 5000), (9, "a b x d f")]
    df, got = run(spark, docs)
    want = brute(docs)
    want.pop((6, 0), None)  # rows of one id share their places: see below
    assert {k: v for k, v in got.items() if k[0] != 6} == want
    assert sum(k[0] == 6 for k in got) == 0
    kept = lines.dedup_lines(df.withColumn("n_chars", F.lit(99)), count_col="n_chars")
    assert kept.columns == [*df.columns, "n_chars"]
    texts = sorted(((str(r.doc_id), r.text, r.n_chars) for r in kept.collect()), key=str)
    assert ("2", "short x\n", 8) in texts and ("3", None, 99) in texts and ("4", "", 99) in texts and ("5", " \t", 2) in texts and ("8", "", 0) in texts
    assert [t for t in texts if t[0] == "6"].count(("6", "q w e r t y", 99)) == 2
    assert lines.dropped_lines(df.limit(0)).count() == 0


def test_many_near_copies_do_not_pair(spark):
    docs = [(i, f"one two three four {i} six seven") for i in range(3000)]
    _, got = run(spark, docs)
    assert got == {(i, 0): ((0, 0), 1) for i in range(1, 3000)}


def test_real_lines(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert run(spark, docs)[1] == brute(docs)


def shuffle_files(spark):
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(found.size()) if (name := found.apply(i).getName()).startswith("shuffle_")}


def test_shuffle_files_go_with_their_step(spark):
    docs = spark.createDataFrame([(i, f"one two three four {i} six seven\nonce {i}") for i in range(300)], "doc_id long, text string")
    before, setting = shuffle_files(spark), spark.conf.get(common.FREE, None)
    lines.dropped_lines(docs)  # all steps but the last, which the caller runs
    end = time.time() + 20
    while (left := shuffle_files(spark) - before) and time.time() < end:
        time.sleep(0.2)
    assert not left and spark.conf.get(common.FREE, None) == setting


def test_overlapping_writes_restore_the_setting(spark):
    setting = spark.conf.get(common.FREE, None)
    try:
        for value in ("false", "true"):
            spark.conf.set(common.FREE, value)
            one, other = common._freeing(spark), common._freeing(spark)
            one.__enter__()
            other.__enter__()
            one.__exit__(None, None, None)
            assert spark.conf.get(common.FREE) == "true"
            other.__exit__(None, None, None)
            assert spark.conf.get(common.FREE) == value
    finally:
        spark.conf.unset(common.FREE) if setting is None else spark.conf.set(common.FREE, setting)


def test_variants_are_made_once(spark, monkeypatch):
    plans = []

    def kept(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return common.materialize(df)

    monkeypatch.setattr(lines, "materialize", kept)
    lines.dropped_lines(spark.createDataFrame([(1, "a b c d e"), (2, "a b c d f")], "doc_id long, text string"))
    # Lines are made by the first step, variants by the last but none: each by one such node.
    assert [p.count("posexplode(") for p in plans if "posexplode(" in p] == [1, 1]
