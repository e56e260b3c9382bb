"""Approximate nearest neighbours by cosine: NN-descent builds a neighbour graph, queries search it greedily.

The graph starts from the best pairs inside cells: a vector's cell is the random direction that it points to most (a few
such digits for large tables), so near vectors often share one; STARTS such partitions are drawn, and a cell larger than
GROUP is dealt to several groups. Each round joins every node's near and reverse neighbours: a node introduces
its neighbours to each other, pairs that beat a neighbour's DEGREE-th best so far replace it, until the share of pairs that are new is below SETTLED. A query starts at its own
node and, hop by hop, joins the best WIDTH nodes of its pool that it hasn't opened yet with their neighbours, keeping the POOL
best, until a query has no node left to open; the best FINAL of the pool are then scored on the original vectors. Both phases work on unit
vectors in half precision. Equal vectors are one node, so that a vector that a third of all rows share is no hub.

Scale: every step is a join or a grouping by node or query whose groups are bounded (top-k windows cut groups before
the shuffle); each round's graph and each hop's pools are written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stow, free_shuffles, table
from .pivot_topk import usable

DEGREE, SAMPLE, GROUP, STARTS, OFFERS = 32, 16, 2048, 10, 6
#: Rows of a cell, about; directions of a digit, at most; pairs that a vector gives in a cell.
CELL, DIRECTIONS, FIRST = 1024, 64, 12
POOL, WIDTH, FINAL = 384, 96, 48
#: The graph is built until a round changes less than this share of its pairs.
SETTLED = 0.01


def _top(df: DataFrame, key: str, n: int, *order: Column) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def _unit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors in half precision, by length."""
    for batch in it:
        lens = batch["v"].value_lengths().to_numpy()
        for n in np.unique(lens):
            part = batch.filter(pa.array(lens == n))
            x = part["v"].flatten().to_numpy().reshape(-1, n)
            x = x / np.abs(x).max(1, keepdims=True)
            x = (x / np.sqrt((x**2).sum(1, keepdims=True))).astype(np.float16)
            yield pa.RecordBatch.from_arrays([part["id"], pa.array(np.full(len(x), n, np.int32)), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "dim", "u"])


def _units(col) -> np.ndarray:
    rows = [x.as_buffer() for x in col]
    return np.frombuffer(b"".join(rows), np.float16).reshape(len(rows), -1).astype(np.float32)


def _pairs(v: list, u: list, s: list) -> pa.Table:
    cat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
    return pa.table({"v": cat(v, np.int64), "u": cat(u, np.int64), "s": cat(s, np.float32)})


def _cells(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each vector with its cell in each of STARTS partitions into about g cells."""
    for batch in it:
        dims, g = batch["dim"].to_numpy(), batch["g"].to_numpy()
        for dim in np.unique(dims):
            part = batch.filter(pa.array(dims == dim))
            x, n = _units(part["u"]), int(g[dims == dim][0])
            digits = max(1, int(np.ceil(np.log(n) / np.log(DIRECTIONS))))
            width = max(1, int(np.ceil(n ** (1 / digits))))
            for t in range(STARTS):
                rng, cell = np.random.default_rng([t, int(dim)]), np.zeros(len(x), np.int64)
                for _ in range(digits):
                    cell = cell * width + (x @ rng.normal(size=(int(dim), width)).astype(np.float32)).argmax(1)
                yield pa.RecordBatch.from_arrays([part["id"], part["u"], part["dim"], pa.array(np.full(len(x), t, np.int32)), pa.array(cell)], names=["id", "u", "dim", "t", "cell"])


def _start(key, t):
    """Each vector's best in its group."""
    ids, x = t["id"].to_numpy(), _units(t["u"])
    n = min(FIRST, len(ids) - 1)
    v, u, best = [], [], []
    for lo in range(0, len(ids) if n > 0 else 0, 512):
        s = x[lo : lo + 512] @ x.T
        s[np.arange(len(s)), lo + np.arange(len(s))] = -9
        at = np.argpartition(-s, n - 1, 1)[:, :n]
        v.append(np.repeat(ids[lo : lo + 512], n))
        u.append(ids[at].ravel())
        best.append(np.take_along_axis(s, at, 1).ravel())
    return _pairs(v, u, best)


def _introduce(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each node's list of (id, unit vector, score to beat): the pairs that beat it, at most OFFERS for each id."""
    for batch in it:
        lists = batch["m"]
        flat, ends = lists.flatten(), lists.offsets.to_numpy()
        ends = ends - ends[0]
        ids, least, raw = flat.field("id").to_numpy(), flat.field("least").to_numpy(), flat.field("u")
        v, u, s = [], [], []
        for a, b in zip(ends, ends[1:], strict=False):
            if b - a < 2:
                continue
            x = _units(raw.slice(a, b - a))
            sim = x @ x.T
            np.fill_diagonal(sim, -9)
            n = min(OFFERS, b - a - 1)
            at = np.argpartition(-sim, n - 1, 1)[:, :n]
            best = np.take_along_axis(sim, at, 1)
            i, j = np.nonzero(best > least[a:b, None])
            v.append(ids[a + i])
            u.append(ids[a + at[i, j]])
            s.append(best[i, j])
        yield from _pairs(v, u, s).to_batches()


def _graph(pairs: DataFrame) -> DataFrame:
    """(v, u, s, new, r): the DEGREE best of each v, ranked; ties in an order that differs from node to node."""
    best = pairs.groupBy("v", "u").agg(F.max("s").alias("s"), F.min("new").alias("new"))
    return best.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy(F.desc("s"), F.xxhash64("v", "u"), "u"))).where(F.col("r") <= DEGREE)


def build(nodes: DataFrame, stow: Stow, rounds: int | None = None) -> DataFrame:
    """The graph (v, u, s, new, r) of nodes (id, dim, u); rounds: at most so many, None as many as it takes to settle."""
    by_dim = nodes.groupBy("dim").agg(F.ceil(F.count("*") / CELL).cast("int").alias("g"))  # a row for each length of vectors
    dealt = nodes.join(F.broadcast(by_dim), "dim").select("id", "u", "dim", "g").mapInArrow(_cells, "id long, u binary, dim int, t int, cell long")
    large = dealt.groupBy("dim", "t", "cell").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts")).where("parts > 1")
    large = stow.put(large, "large")
    large = F.broadcast(large) if large.limit(100_001).count() <= 100_000 else large
    dealt = dealt.join(large, ["dim", "t", "cell"], "left").withColumn("k", F.pmod(F.xxhash64("id", "t"), F.coalesce("parts", F.lit(1))))
    g = stow.put(_graph(dealt.groupBy("dim", "t", "cell", "k").applyInArrow(_start, "v long, u long, s float").withColumn("new", F.lit(True))), "graph0")
    free_shuffles(nodes.sparkSession)
    # scores only rise, so the rounds come to an end
    k, changed = 0, 1.0
    while changed >= SETTLED and (rounds is None or k < rounds):
        k += 1
        back = _top(g.select(F.col("u").alias("v"), F.col("v").alias("u"), "s"), "v", SAMPLE, F.desc("s"), F.xxhash64("v", "u"), F.col("u"))
        near = g.where(F.col("r") <= SAMPLE).select("v", "u").unionByName(back.select("v", "u")).distinct()
        least = g.groupBy("v").agg(F.when(F.count("*") >= DEGREE, F.min("s")).otherwise(F.lit(-9.0)).cast("float").alias("least"))
        known = nodes.select("id", F.col("u").alias("x")).join(least.withColumnRenamed("v", "id"), "id")
        lists = near.withColumnRenamed("u", "id").join(known, "id").groupBy("v").agg(F.collect_list(F.struct("id", "least", F.col("x").alias("u"))).alias("m"))
        offers = lists.select("m").mapInArrow(_introduce, "v long, u long, s float")
        g = stow.put(_graph(g.select("v", "u", "s").withColumn("new", F.lit(False)).unionByName(offers.withColumn("new", F.lit(True)))), f"graph{k}")
        changed = g.agg(F.avg(F.col("new").cast("int"))).first()[0] or 0.0
        stow.drop(f"graph{k - 1}")
        free_shuffles(nodes.sparkSession)
    return g


def _step(key, state, found):
    """Adds the nodes found to a query's pool and names those to open next."""
    q = key[0].as_py()
    x, ids = _units(found["x"]) if found.num_rows else None, found["w"].to_numpy()
    row = state.slice(0, 1).to_pylist()[0]
    have, scores, done = np.array(row["ids"], np.int64), np.array(row["scores"], np.float32), np.array(row["done"], bool)
    done[:] |= np.isin(have, np.array(row["open"], np.int64))
    if x is not None:
        new = ~np.isin(ids, have) & (ids != q)
        ids, x = ids[new], x[new]
        have = np.concatenate([have, ids])
        scores = np.concatenate([scores, x @ np.frombuffer(row["u"], np.float16).astype(np.float32)])
        done = np.concatenate([done, np.zeros(len(ids), bool)])
    top = np.argsort(-scores, kind="stable")[:POOL]
    have, scores, done = have[top], scores[top], done[top]
    nxt = have[~done][:WIDTH]
    return pa.table({"q": pa.array([q], pa.int64()), "u": pa.array([row["u"]], pa.binary()), "ids": pa.array([have.tolist()], pa.list_(pa.int64())), "scores": pa.array([scores.tolist()], pa.list_(pa.float32())), "done": pa.array([done.tolist()], pa.list_(pa.bool_())), "open": pa.array([nxt.tolist()], pa.list_(pa.int64()))})


def search(vectors: DataFrame, is_query: Column, k: int = 5, *, id_col: str = "vec_id", vec_col: str = "embedding", rounds: int | None = None, hops: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row, its k nearest other rows found, by cosine of the original vectors.

    Ties go to the smaller id. Null ids and vectors that are null, empty, zero or hold null or non-finite components take no
    part. Vectors of different lengths aren't compared. Rows with equal vectors are found together. A row isn't compared
    with rows of its own id. Fewer than k candidates: all that are found. Other columns are ignored. rounds, hops: at
    most so many; None: until the graph settles, until no query has a node left to open.
    """
    spark = vectors.sparkSession
    stow = Stow(spark)
    rows = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vec_col))).select(F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("query"), F.transform(vec_col, lambda x: x.cast("double")).alias("v")).where(F.exists("v", lambda x: x != 0))
    rows = stow.put(rows, "rows")
    classes = rows.groupBy("v").agg(F.min("id").alias("node"))
    nodes = stow.put(classes.select(F.col("node").alias("id"), "v").mapInArrow(_unit, "id long, dim int, u binary"), "nodes")
    g = build(nodes, stow, rounds)
    back = _top(g.select(F.col("u").alias("v"), F.col("v").alias("u"), "s"), "v", DEGREE, F.desc("s"), F.xxhash64("v", "u"), F.col("u"))
    links = stow.put(g.select("v", "u").unionByName(back.select("v", "u")).distinct().groupBy("v").agg(F.collect_list("u").alias("links")), "links")
    asked = rows.where("query").join(classes, "v").select("id", "node").distinct()
    asked = stow.put(asked, "asked")

    none = lambda t: F.array().cast(f"array<{t}>")
    schema = "q long, u binary, ids array<long>, scores array<float>, done array<boolean>, open array<long>"
    state = nodes.join(asked.select(F.col("node").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("q"), "u", none("long").alias("ids"), none("float").alias("scores"), none("boolean").alias("done"), F.array("id").alias("open"))
    state = stow.put(state, "state")
    at = nodes.select(F.col("id").alias("w"), F.col("u").alias("x"))
    h = 0
    while (hops is None or h < hops) and not state.where(F.size("open") > 0).isEmpty():
        seen = state.select("q", F.explode("open").alias("v")).join(links, "v").select("q", F.explode("links").alias("w")).distinct()
        seen = seen.join(state.select("q", F.explode("ids").alias("w")), ["q", "w"], "left_anti")
        state = stow.put(state.groupBy("q").cogroup(seen.join(at, "w").select(F.col("q").alias("q_"), "w", "x").groupBy("q_")).applyInArrow(_step, schema), f"state{h}")
        h += 1
        free_shuffles(spark)

    pool = state.select("q", F.posexplode("ids").alias("pos", "w")).where(F.col("pos") < FINAL).select("q", "w").unionByName(state.select("q", F.col("q").alias("w")))
    vec = classes.select(F.col("node").alias("w"), F.col("v").alias("b"))
    ends = pool.join(vec, "w").join(classes.select(F.col("node").alias("q"), F.col("v").alias("a")), "q")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, r: p * r), F.lit(0.0), lambda s, z: s + z)
    scored = ends.select("q", "w", (dot("a", "b") / (F.sqrt(dot("a", "a")) * F.sqrt(dot("b", "b")))).alias("score"))
    # of equal vectors only the k + 1 smallest ids can be among the k nearest
    members = rows.join(classes, "v").select("node", "id").join(pool.select(F.col("w").alias("node")).distinct(), "node", "left_semi")
    members = _top(members, "node", k + 1, F.col("id"))
    out = asked.select(F.col("id").alias("query_id"), F.col("node").alias("q")).join(scored, "q").join(members.select(F.col("node").alias("w"), F.col("id").alias("vec_id")), "w").where("query_id <> vec_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors found for every 50th vector."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)
