"""Connected components by contraction, in joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stow


def components(edges: DataFrame, stow: Stow) -> DataFrame:
    """(id, component) for every end of the edges (a, b); component is the smallest id reachable.

    Each round points every vertex to its smallest neighbour or itself, follows the pointers twice and contracts
    the edges, so the rounds grow with the logarithm of the largest diameter. Every round's tables are written to
    the shared folder; degrees may be as large as they like, minima are taken before the shuffle.
    """
    edges = stow.put(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    labels, k = None, 0
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = stow.put(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("p")), f"point{k}")
        for _ in range(2):
            up = point.select(F.col("v").alias("p"), F.col("p").alias("q"))
            point = point.join(up, "p").select("v", F.col("q").alias("p"))
        point = stow.put(point, f"far{k}")
        pa, pb = point.toDF("a", "x"), point.toDF("b", "y")
        nxt = edges.join(pa, "a").join(pb, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        nxt = stow.put(nxt, f"edges{k}")
        fresh = point.select(F.col("v").alias("id"), F.col("p").alias("component"))
        if labels is not None:
            moved = point.toDF("component", "to")
            fresh = labels.join(moved, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
        labels = stow.put(fresh, f"labels{k}")
        edges, k = nxt, k + 1
    if labels is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return labels
