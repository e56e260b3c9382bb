"""Exact top-k inner product search by pivot-table elimination.

Inner product order is distance order once norms are known: q.x = (|q|^2 + |x|^2 - d(q, x)^2) / 2. A table holds
every vector's distance to PIVOTS pivots. By the triangle inequality max_p |d(q, p) - d(x, p)| bounds d(q, x)
from below, and so q.x from above. A query's candidates are evaluated in the order of that bound until it falls
below the k-th best score so far, which starts at the k-th best among the pivots. Rows level with the k-th are
always evaluated, so results, ties included, are exact. Scores are computed in whole numbers: as doubles or longs
where the components' sizes prove that no sum can leave their range, as unbounded integers otherwise.

Scale: candidates lie in the cell of their nearest pivot. A cell's interval of distances to every pivot gives a bound
for all its rows, so a query is sent only to the cells that can hold one of its k best; a cell is cut into blocks of
bounded size, (cell, part of its candidates, part of its queries), one task's work each, that pass on k rows a
query at most. Pivots are chosen on a sample of SAMPLE rows by farthest-first traversal; they and the cells'
intervals, PIVOTS rows, are all that the driver holds and sends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stow, table

PIVOTS, SAMPLE = 32, 4096
#: Rows of a block: queries and candidates.
QUERIES, CANDIDATES = 4096, 8192
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def usable(v: Column) -> Column:
    """Whether an array is there, isn't empty and has neither null nor non-finite components."""
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def quantised(v: Column, scale: int = 1024) -> Column:
    return F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def _matrix(col, dim: int) -> np.ndarray:
    """Rows of binary vectors of int32, or of int64 where a component needs it, as int64."""
    rows = [x.as_buffer() for x in col]
    if all(x.size == 4 * dim for x in rows):
        return np.frombuffer(b"".join(rows), np.int32).reshape(len(rows), dim).astype(np.int64)
    return np.stack([np.frombuffer(x, np.int32 if x.size == 4 * dim else np.int64).astype(np.int64) for x in rows])


def exact(x: np.ndarray, most: int) -> np.ndarray:
    """Whole numbers (int64) of which `most` is the largest product sum, in a type that holds all sums of products."""
    return x.astype(np.float64) if most < 1 << 53 else x if most < 1 << 63 else x.astype(object)


def _largest(*xs: np.ndarray) -> int:
    """A bound of the inner products of rows of int64 matrices."""
    sizes = [max(-int(x.min()), int(x.max()), 0) if x.size else 0 for x in xs]
    return sizes[0] * sizes[-1] * (xs[0].shape[1] if xs[0].ndim == 2 else 0)


def choose(sample: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Places of n rows of the sample (fewer if it has fewer different ones), each farthest from those before."""
    if not len(sample):
        return np.zeros(0, np.int64)
    out, far = [0], np.full(len(sample), np.inf)
    while len(out) < n:
        far = np.minimum(far, ((sample - sample[out[-1]]) ** 2).sum(1))
        if far.max() == 0:
            break
        out.append(int(far.argmax()))
    return np.array(out)


def upper(qn: np.ndarray, xn: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """A bound of inner products from above, by squared norms and a lower bound of the distance, with room for rounding."""
    return (qn + xn - np.maximum(0, lower - 1e-9 * np.sqrt(qn + xn)) ** 2) / 2 + 1e-9 * (qn + xn) + 1


def best(q: np.ndarray, qid: np.ndarray, qd: np.ndarray, x: np.ndarray, xid: np.ndarray, xd: np.ndarray, floor: np.ndarray, k: int, step: int = 256) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, ids, scores) of each query's k best of a block, by elimination; floor: scores that k rows are known to reach. q and x are int64."""
    most = _largest(q, x)
    real_q, real_x = q.astype(np.float64), x.astype(np.float64)
    qn, xn = (real_q**2).sum(1), (real_x**2).sum(1)
    q, x = exact(q, most), exact(x, most)
    for i in range(len(q)):
        lower = np.abs(xd - qd[i]).max(1) if xd.shape[1] else np.zeros(len(x))
        bound = upper(qn[i], xn, lower)
        order = np.argsort(-bound, kind="stable")
        ids, scores, least = np.zeros(0, np.int64), np.zeros(0, x.dtype), floor[i]
        for lo in range(0, len(order), step):
            part = order[lo : lo + step]
            if bound[part[0]] < least:
                break
            part = part[(bound[part] >= least) & (xid[part] != qid[i])]
            s = x[part].dot(q[i])
            ids, scores = np.concatenate([ids, xid[part]]), np.concatenate([scores, s])
            top = np.lexsort((ids, -scores))[:k] if scores.dtype != object else np.array(sorted(range(len(ids)), key=lambda j: (-scores[j], ids[j]))[:k], np.int64)
            ids, scores = ids[top], scores[top]
            if len(ids) == k:
                least = max(least, float(scores[-1]) * (1 - 1e-12) - 1 if most >= 1 << 53 and scores[-1] > 0 else float(scores[-1]) * (1 + 1e-12) - 1)
        yield i, ids, scores


def _block(k: int):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "query": [], "vec_id": [], "high": [], "low": []}
        if left.num_rows and right.num_rows:
            dim = key[0].as_py()
            q, x = _matrix(left["v"], dim), _matrix(right["v"], dim)
            qd, xd = (np.frombuffer(b"".join(c.as_buffer() for c in t["d"]), np.float64).reshape(t.num_rows, -1) for t in (left, right))
            qid, xid, prints = left["id"].to_numpy(), right["id"].to_numpy(), left["print"].to_pylist()
            for i, ids, scores in best(q, qid, qd, x, xid, xd, left["floor"].to_numpy(), k):
                out["query_id"] += [qid[i]] * len(ids)
                out["query"] += [prints[i]] * len(ids)
                out["vec_id"] += ids.tolist()
                for s in scores.tolist():  # a score as high * 2**32 + low: a long can be too small for it
                    high, low = divmod(int(s), 1 << 32)
                    out["high"].append(float(high) if abs(high) >= 1 << 53 else high)
                    out["low"].append(low)
        kinds = {"query": pa.binary(), "high": pa.float64()}
        return pa.table({c: pa.array(v, kinds.get(c, pa.int64())) for c, v in out.items()})

    return run


def search(vectors: DataFrame, is_query: Column, k: int = 10, *, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best other rows by inner product of floor(scale * x), ties to the smaller id.

    Null ids and vectors that are null, empty or hold null or non-finite components take no part. Vectors of different
    lengths aren't compared. Query rows that share an id have a list each, equal query rows one list. A row isn't
    compared with rows of its own id; other repeated rows are separate candidates. Fewer than k candidates: all.
    Components and scores beyond a long stop at its limits; up to 2**84 scores are still ranked by their exact value.
    Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vec_col))).select(F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("query"), quantised(F.col(vec_col), scale).alias("v"))
    picked = rows.orderBy(F.xxhash64("id"), "id", "v").select("id", "v").limit(SAMPLE).toPandas()
    dim = int(picked.v.map(len).mode().max()) if len(picked) else 0
    picked = picked[picked.v.map(len) == dim]
    sample = np.stack(picked.v.to_list()).astype(np.int64) if len(picked) else np.zeros((0, dim), np.int64)
    at = choose(sample.astype(np.float64))
    whole, pivot_ids = sample[at], picked.id.to_numpy()[at]
    pivots = whole.astype(np.float64)

    def distances(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            lens = batch["v"].value_lengths().to_numpy()
            for n in np.unique(lens):
                part = batch.filter(pa.array(lens == n))
                v = part["v"].flatten().to_numpy().reshape(-1, n)
                x = v.astype(np.float64)
                d = np.sqrt(((x[:, None, :] - pivots[None]) ** 2).sum(2)) if n == dim and len(pivots) else np.zeros((len(v), 0))
                cell = d.argmin(1) if d.shape[1] else np.full(len(v), -1)
                floor = np.full(len(v), -np.inf)
                if d.shape[1] > k:
                    most = _largest(v, whole)
                    s = exact(v, most).dot(exact(whole, most).T).astype(np.float64)
                    s -= 1 + 1e-12 * np.abs(s)
                    s[pivot_ids[None, :] == part["id"].to_numpy()[:, None]] = -np.inf
                    floor = -np.sort(-s, 1)[:, k - 1]
                narrow = (np.abs(v.astype(np.float64)) < 1 << 31).all(1)
                raw = [r.astype(np.int32).tobytes() if ok else r.tobytes() for r, ok in zip(v, narrow, strict=True)]
                yield pa.RecordBatch.from_arrays([part["id"], part["query"], pa.array(np.full(len(v), n, np.int32)), pa.array(raw, pa.binary()), pa.array([r.tobytes() for r in d], pa.binary()), pa.array(cell, pa.int32()), pa.array(floor), pa.array((x**2).sum(1))], names=["id", "query", "dim", "v", "d", "cell", "floor", "norm"])

    def ranges(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """By length and cell: rows, largest squared norm, and the least and largest distance to each pivot."""
        have: dict[tuple[int, int], list] = {}
        for batch in it:
            for row in zip(*(batch[c].to_pylist() for c in ("dim", "cell", "norm", "d")), strict=True):
                own = have.setdefault(row[:2], [0, 0.0, None, None])
                d = np.frombuffer(row[3], np.float64)
                own[:2] = own[0] + 1, max(own[1], row[2])
                own[2:] = (d, d) if own[2] is None else (np.minimum(own[2], d), np.maximum(own[3], d))
        keys = list(have)
        cols = [pa.array([x[0] for x in keys], pa.int32()), pa.array([x[1] for x in keys], pa.int32()), *(pa.array([have[x][j] for x in keys], t) for j, t in ((0, pa.int64()), (1, pa.float64()))), *(pa.array([have[x][j].tolist() for x in keys], pa.list_(pa.float64())) for j in (2, 3))]
        yield pa.RecordBatch.from_arrays(cols, names=["dim", "cell", "n", "norm", "near", "far"])

    stow = Stow(spark)
    pivot_table = stow.put(rows.select("id", "query", "v").mapInArrow(distances, "id long, query boolean, dim int, v binary, d binary, cell int, floor double, norm double"), "pivots")
    parts = pivot_table.select("dim", "cell", "norm", "d").mapInArrow(ranges, "dim int, cell int, n long, norm double, near array<double>, far array<double>")
    least = lambda c, f: F.array(*[f(F.get(c, F.lit(p))) for p in range(len(pivots))]).alias(c)
    cells = parts.groupBy("dim", "cell").agg(F.sum("n").alias("n"), F.max("norm").alias("norm"), least("near", F.min), least("far", F.max))
    cells = stow.put(cells.withColumn("splits", F.ceil(F.col("n") / CANDIDATES).cast("int")), "cells")  # at most PIVOTS rows, and one for each other length
    queries = pivot_table.where("query").groupBy("id", "v", "dim").agg(F.first("d").alias("d"), F.first("cell").alias("cell"), F.first("floor").alias("floor"), F.first("norm").alias("norm"))
    queries = queries.withColumn("print", F.unhex(F.md5("v")))
    known = {(r.dim, r.cell): (r.norm, np.array(r.near, np.float64), np.array(r.far, np.float64)) for r in cells.where(F.col("cell") >= 0).collect()}

    def reach(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query once for every cell that can hold one of its k best."""
        for batch in it:
            n, floor, norm = (batch[c].to_numpy() for c in ("dim", "floor", "norm"))
            d = [np.frombuffer(x.as_buffer(), np.float64) for x in batch["d"]]
            picks, to = [], []
            for i in range(batch.num_rows):
                if not len(d[i]):
                    picks.append(i)
                    to.append(-1)
                    continue
                for (of, cell), (top, near, far) in known.items():
                    low = np.maximum(np.maximum(near - d[i], d[i] - far), 0).max()
                    if of == n[i] and upper(norm[i], top, low) >= floor[i]:
                        picks.append(i)
                        to.append(cell)
            at = pa.array(picks, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch[c].take(at) for c in ("id", "print", "dim", "v", "d", "floor")), pa.array(to, pa.int32())], names=["id", "print", "dim", "v", "d", "floor", "cell"])

    sent = stow.put(queries.mapInArrow(reach, "id long, print binary, dim int, v binary, d binary, floor double, cell int"), "queries")
    asked = sent.groupBy("dim", "cell").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("shards"))
    plan = cells.select("dim", "cell", "splits").join(asked, ["dim", "cell"])
    plan = F.broadcast(plan) if plan.count() <= 100_000 else plan
    mine = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = sent.join(plan, ["dim", "cell"]).withColumn("shard", mine("shards", 1)).withColumn("part", each("splits"))
    right = pivot_table.select("id", "v", "d", "dim", "cell").join(plan, ["dim", "cell"]).withColumn("part", mine("splits", 2)).withColumn("shard", each("shards"))
    keys = ["dim", "cell", "shard", "part"]
    left, right = left.select(*keys, "id", "print", "v", "d", "floor"), right.select(*keys, "id", "v", "d")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_block(k), "query_id long, query binary, vec_id long, high double, low long")
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("high"), F.desc("low"), "vec_id")
    fits = F.col("high").between(-(2.0**31), 2.0**31 - 1)
    score = F.when(fits, F.when(fits, F.col("high")).otherwise(0).cast("long") * (1 << 32) + F.col("low")).when(F.col("high") < 0, LEAST).otherwise(MOST)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", score.alias("score"))


def op3_exact_topk(spark, sf_dir: str) -> DataFrame:
    """The 10 highest integer inner products of every 100th vector."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS HUGEINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
q AS (SELECT DISTINCT vec_id, e FROM v WHERE vec_id % 100 = 0),
s AS (
  SELECT q.vec_id AS query_id, q.e AS query, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, query ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
