"""The neighbour graph of random vectors against brute force."""

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import nn_descent
from tessera.llm.common import Stow


def test_graph_settles(spark):
    """From random groups the graph settled at 0.72 here."""
    x = np.random.default_rng(4).normal(size=(4000, 48))
    x = (x / np.sqrt((x**2).sum(1, keepdims=True))).astype(np.float16)
    nodes = spark.createDataFrame([(i, 48, r.tobytes()) for i, r in enumerate(x)], "id long, dim int, u binary")
    g = nn_descent.build(nodes, Stow(spark)).where(F.col("r") <= 5).toPandas()
    s = x.astype(np.float32) @ x.astype(np.float32).T
    np.fill_diagonal(s, -9)
    fifth = -np.partition(-s, 4, 1)[:, 4]
    assert (g.s.to_numpy() >= fifth[g.v.to_numpy()] - 1e-5).sum() >= 0.9 * 5 * len(x)


def test_recall_on_clusters_and_noise(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(6000, 64)), rng.normal(size=(30, 64)).repeat(100, 0) + 0.3 * rng.normal(size=(3000, 64)), np.tile(rng.normal(size=64), (500, 1))]).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(8)
    got = nn_descent.search(rows, F.col("vec_id") % 50 == 0, 5).collect()
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    q = np.arange(0, len(x), 50)
    s = y[q] @ y.T
    s[np.arange(len(q)), q] = -9
    fifth = -np.partition(-s, 4, 1)[:, 4]
    assert len(got) == 5 * len(q)
    assert sum(r.score >= fifth[r.query_id // 50] - 1e-9 for r in got) >= 0.95 * len(got)
