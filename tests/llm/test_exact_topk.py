"""Exact search on large components, repeated ids and other lengths, against brute force in unbounded integers."""

import math
import random

from pyspark.sql import functions as F

from tessera.llm import pivot_topk


def brute(rows, k, scale=1024):
    vs = [(i, tuple(max(-(1 << 63), min((1 << 63) - 1, math.floor(scale * x))) for x in v)) for i, v in rows]
    out = []
    for q, v in sorted(set(r for r in vs if r[0] % 100 == 0)):
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in vs if i != q and len(w) == len(v))
        out += [(q, r + 1, i, max(-(1 << 63), min((1 << 63) - 1, -s))) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def run(spark, rows, k=10):
    df = spark.createDataFrame([(i, [float(x) for x in v], 1) for i, v in rows], "vec_id long, embedding array<double>, cell int").repartition(3)
    return sorted(map(tuple, pivot_topk.search(df, F.col("vec_id") % 100 == 0, k).collect()))


def test_repeated_ids_and_lengths(spark):
    rng = random.Random(2)
    rows = [(rng.choice([0, 100, 200, i]), [rng.uniform(-1, 1) for _ in range(rng.choice([6, 6, 6, 4]))]) for i in range(1, 300)]
    rows += [rows[0]] * 3 + [(0, [0.5] * 6), (0, [0.5] * 6), (0, [-0.25] * 6), *[(i, [0.25] * 6) for i in range(301, 330)]]
    assert run(spark, rows) == brute(rows, 10)


def test_large_components(spark):
    rng = random.Random(3)
    for size in (70_000, 2.0**25, 2.0**40, 2.0**52):
        rows = [(i, [rng.choice([size, -size, 1.0, rng.uniform(-size, size)]) for _ in range(16)]) for i in range(240)]
        assert run(spark, rows) == brute(rows, 10)


def test_few_rows(spark):
    assert run(spark, [(100, [70000.0, 1.0]), (1, [70000.0, 2.0])]) == brute([(100, [70000.0, 1.0]), (1, [70000.0, 2.0])], 10)
