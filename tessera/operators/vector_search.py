"""Vector search: exact with filters, inverted lists, and advice on indexes."""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import METRICS, distance, literal


def knn(df: DataFrame, vec: str, query: list[float], k: int = 10, metric: str = "cosine", where: Column | None = None, id_col: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """The k nearest rows that meet `where`, with their distance; ties by id_col. A heap per task.

    Rows without a distance take no part: null vectors, other lengths, null or non-finite components.
    """
    df = df.where(where) if where is not None else df
    c = F.col(vec)
    fine = (F.size(c) == len(query)) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    out = df.where(fine).withColumn("distance", distance(c, literal(query), metric)).where("distance is not null and not isnan(distance)")
    out = out.orderBy("distance", *([id_col] if id_col else [])).limit(k)
    return out.select(*columns, "distance") if columns else out


class IvfIndex:
    """Inverted lists: vectors are filed under the nearest of nlist centroids, a query scans n_probe lists.

    Centroids come from k-means on a sample of at most `sample` rows; the lists are partitions of a table, so a
    probe reads only its folders.
    """

    def __init__(self, df: DataFrame, vec: str, id_col: str, path: str, nlist: int = 64, sample: int = 50_000, seed: int = 1, iterations: int = 10):
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector, vector_to_array

        self.spark, self.vec, self.id_col, self.path = df.sparkSession, vec, id_col, path
        fit = df.where(F.col(vec).isNotNull()).orderBy(F.xxhash64(id_col)).limit(sample).select(array_to_vector(F.transform(vec, lambda x: x.cast("double"))).alias("features"))
        model = KMeans(k=nlist, seed=seed, maxIter=iterations).fit(fit)
        self.centroids = [[float(x) for x in c] for c in model.clusterCenters()]
        filed = model.transform(df.where(F.col(vec).isNotNull()).withColumn("features", array_to_vector(F.transform(vec, lambda x: x.cast("double"))))).drop("features").withColumnRenamed("prediction", "list")
        filed.write.mode("overwrite").partitionBy("list").parquet(path)

    def search(self, query: list[float], k: int = 10, n_probe: int = 8, metric: str = "l2") -> DataFrame:
        """The k nearest rows in the n_probe lists whose centroids are nearest to the query."""
        near = sorted(range(len(self.centroids)), key=lambda i: math.dist(self.centroids[i], query))[:n_probe]
        return knn(self.spark.read.parquet(self.path).where(F.col("list").isin(near)), self.vec, query, k, metric, id_col=self.id_col)


def index_cost(rows: int, dims: int, k: int = 10, index: str | None = None, **params: int) -> float:
    """Distance components a search computes: all rows, centroids and probed lists, or a graph walk."""
    if index in (None, "exact"):
        return float(rows * dims)
    if index == "ivf":
        nlist = params.get("nlist", int(math.sqrt(rows)))
        probe = params.get("n_probe", max(1, nlist // 10))
        return (nlist + rows / max(nlist, 1) * probe) * dims
    if index == "graph":
        return math.log2(max(rows, 2)) * params.get("ef_search", max(k, 64)) * dims
    raise ValueError(index)


def recommend_index(rows: int, dims: int, qps: float = 10.0) -> dict[str, Any]:
    """exact for under 100,000 rows of under 512 dimensions, ivf for under 10 million rows and 100 queries a second, else a graph."""
    mb = rows * dims * 4 / (1024 * 1024)
    if rows < 100_000 and dims < 512:
        return {"index": "exact", "params": {}, "data_mb": mb}
    if rows < 10_000_000 and qps < 100:
        nlist = min(int(math.sqrt(rows)), 4096)
        return {"index": "ivf", "params": {"nlist": nlist, "n_probe": max(1, nlist // 10)}, "data_mb": mb}
    return {"index": "graph", "params": {"m": 16 if dims <= 768 else 32, "ef_construction": 200}, "data_mb": mb}


__all__ = ["METRICS", "IvfIndex", "index_cost", "knn", "recommend_index"]
