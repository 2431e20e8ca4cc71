import math
import random

import numpy as np
from pyspark.sql import functions as F

from perigee.llm import embeddings


def brute(rows, threshold=0.9):
    good = [k for k, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in good:
        for b in good:
            if a < b and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(rows[k][1]) / max(map(abs, rows[k][1])) for k in (a, b))
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= threshold:
                    links[a] += 1
                    links[b] += 1
                    root[max(find(a), find(b))] = min(find(a), find(b))
    names = {}
    for k in range(len(rows)):
        if rows[k][0] is not None:
            names[find(k)] = min(names.get(find(k), rows[k][0]), rows[k][0])
    return sorted(((str(rows[k][0]), links[k], names.get(find(k)), rows[k][0] == names.get(find(k))) for k in range(len(rows))), key=str)


def check(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n", F.lit("x")).withColumn("v", F.lit(1))
    got = embeddings.embedding_groups(df, **more).collect()
    assert sorted(((str(r.id), r.n_links, r.component_id, r.kept) for r in got), key=str) == brute(rows)


def test_random_vectors_and_tiles(spark):
    rng = random.Random(2)
    rows, bases = [], [[rng.gauss(0, 1) for _ in range(40)] for _ in range(12)]
    for k in range(260):
        base = rng.choice(bases)
        noise = rng.choice((0, 0.1, 0.3, 0.45, 3))
        rows.append((k, [x + rng.gauss(0, noise) if noise else x for x in base]))
    check(spark, rows)
    check(spark, rows, tile=16)


def test_odd_rows(spark):
    one = [1.0, 2.0, 3.0]
    rows = [(1, one), (2, [2.0, 4.0, 6.0]), (2, [2.0, 4.0, 6.0]), (None, one), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 3.0]), (7, [float("nan"), 1.0, 1.0]), (8, [float("inf"), 1.0, 1.0]), (9, [1.0, 2.0]), (10, [1.0, 2.0, 3.0, 0.0]), (11, [1e-300, 2e-300, 3e-300]), (12, [1e300, 2e300, 3e300]), (13, [-1.0, -2.0, -3.0])]
    check(spark, rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").limit(0)
    assert embeddings.embedding_groups(df).count() == 0
