"""Aggregates by specification, percentiles, sketches, profiles and rollups."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

#: Function names of specifications.
FUNCTIONS = {
    "count": F.count, "sum": F.sum, "avg": F.avg, "mean": F.avg, "min": F.min, "max": F.max, "count_distinct": F.count_distinct,
    "stddev": F.stddev_samp, "variance": F.var_samp, "median": F.median, "approx_distinct": lambda c: F.approx_count_distinct(c, 0.023),
    "collect_list": F.collect_list, "first": F.first, "last": F.last,
}


def aggregate(df: DataFrame, keys: list[str], spec: list[tuple[str, str, str]], having: Column | None = None) -> DataFrame:
    """GROUP BY keys (none: one row) with (function, column or *, alias); columns that aren't there are left out. Null keys are a group."""
    cols = []
    for fn, col, alias in spec:
        if col == "*":
            cols.append(F.count("*").alias(alias))
        elif col in df.columns:
            cols.append(FUNCTIONS[fn.lower()](F.col(col)).alias(alias))
    out = df.groupBy(*keys).agg(*cols) if keys else df.agg(*cols)
    return out.where(having) if having is not None else out


def percentiles(df: DataFrame, keys: list[str], col: str, ps: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Exact, interpolated: p50, p95, ..."""
    aggs = [F.percentile(col, p).alias(f"p{p * 100:g}".replace(".", "_")) for p in ps]
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def approx_percentile(col: str, p: float, accuracy: int = 10_000) -> Column:
    return F.approx_percentile(col, p, accuracy)


def index_percentile(col: str, p: float) -> Column:
    """The value at place floor(p * n) of the sorted values, without interpolation; null values don't count."""
    v = F.array_sort(F.collect_list(col))
    return F.get(v, F.least(F.floor(F.size(v) * p), F.size(v) - 1).cast("int"))


def rate(condition: Column) -> Column:
    """Share of rows for which a condition is true."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def filtered_over(fn: str, arg: Column | None, condition: Column, window: Any) -> Column:
    """agg(arg) FILTER (WHERE condition) OVER window, which Spark has no syntax for; arg None is count(*)."""
    value = F.when(condition, F.lit(1) if arg is None else arg)
    return FUNCTIONS[fn](value).over(window)


def correlation(a: str, b: str) -> Column:
    """Pearson's r; 0 for fewer than three pairs or no spread."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    r = F.corr(a, b)
    return F.when(F.count_if(both) < 3, 0.0).otherwise(F.coalesce(F.nanvl(r, F.lit(0.0)), F.lit(0.0)))


def hll_sketch(df: DataFrame, keys: list[str], col: str, lg_k: int = 12) -> DataFrame:
    """A mergeable cardinality sketch per group."""
    return df.groupBy(*keys).agg(F.hll_sketch_agg(col, F.lit(lg_k)).alias("sketch"))


def hll_merge(sketches: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Estimated distinct values of merged sketches."""
    return sketches.groupBy(*(keys or [])).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))


def ndv_estimate(df: DataFrame, col: str, stats: int | None = None) -> int:
    """Distinct values by sketch; of an empty frame the statistics' value, else 1,000."""
    n = df.agg(F.approx_count_distinct(col, 0.023)).first()[0]
    return int(n) if n else int(stats or 1000)


def count_min(df: DataFrame, col: str, values: list[Any], width: int = 1024, depth: int = 5) -> DataFrame:
    """(value, estimate) from a count-min sketch of width x depth; never below the true count.

    Counters are sums over hashed cells, so the sketch is a plain aggregate of width * depth rows.
    """
    spark = df.sparkSession
    cell = lambda c: F.array(*[F.struct(F.lit(d).alias("d"), F.pmod(F.xxhash64(F.lit(d), c.cast("string")), F.lit(width)).alias("i")) for d in range(depth)])
    cells = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("v")).agg(F.count("*").alias("n")).select("n", F.explode(cell(F.col("v"))).alias("c")).groupBy("c.d", "c.i").agg(F.sum("n").alias("n"))
    asked = spark.createDataFrame([(v,) for v in values], f"value {dict(df.dtypes)[col]}").select("value", F.explode(cell(F.col("value"))).alias("c")).select("value", "c.d", "c.i")
    return asked.join(cells, ["d", "i"], "left").groupBy("value").agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))


def profile(df: DataFrame) -> DataFrame:
    """One row per column: n, nulls, null_fraction, ndv, min, max (as text), mean and stddev of numbers. One pass."""
    aggs: list[Column] = [F.count("*").alias("n")]
    for k, f in enumerate(df.schema):
        c, number = F.col(f"`{f.name}`"), isinstance(f.dataType, NumericType)
        aggs += [F.count(c).alias(f"c{k}"), F.approx_count_distinct(c, 0.01).alias(f"d{k}"), F.min(c).cast("string").alias(f"lo{k}"), F.max(c).cast("string").alias(f"hi{k}")]
        aggs += [(F.avg(c) if number else F.lit(None)).cast("double").alias(f"m{k}"), (F.stddev_samp(c) if number else F.lit(None)).cast("double").alias(f"s{k}")]
    rows = F.array(*[
        F.struct(F.lit(f.name).alias("column"), F.col("n"), (F.col("n") - F.col(f"c{k}")).alias("nulls"), F.try_divide(F.col("n") - F.col(f"c{k}"), "n").alias("null_fraction"),
                 F.col(f"d{k}").alias("ndv"), F.col(f"lo{k}").alias("min"), F.col(f"hi{k}").alias("max"), F.col(f"m{k}").alias("mean"), F.col(f"s{k}").alias("stddev"))
        for k, f in enumerate(df.schema)
    ])
    return df.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*")


def top_values(df: DataFrame, col: str, n: int = 5) -> DataFrame:
    """The most frequent values; ties by value."""
    return df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(n)


def most_common(df: DataFrame, col: str, n: int = 10) -> DataFrame:
    """Most common values with their share of all rows."""
    total = df.agg(F.count("*").alias("total"))
    return top_values(df, col, n).join(F.broadcast(total)).select("value", "n", (F.col("n") / F.col("total")).alias("frequency"))


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, StringType)]


def equi_depth(df: DataFrame, col: str, buckets: int = 10) -> DataFrame:
    """Bounds of buckets with equal numbers of rows: (position, bound)."""
    ps = [k / buckets for k in range(buckets + 1)]
    return df.agg(F.percentile(col, F.array(*[F.lit(p) for p in ps])).alias("b")).select(F.posexplode("b").alias("position", "bound"))


def cost_rollup(df: DataFrame, engine: str, cost: str) -> DataFrame:
    """Queries, total and mean cost by engine, dearest first."""
    return df.groupBy(engine).agg(F.count("*").alias("queries"), F.sum(cost).alias("total_cost"), F.avg(cost).alias("avg_cost")).orderBy(F.desc("total_cost"))


def budget_status(usage: DataFrame, budgets: DataFrame, key: str, time_col: str, cost: str) -> DataFrame:
    """Spending by key and month against (key, budget); keys without spending are kept."""
    spent = usage.groupBy(key, F.date_trunc("month", time_col).alias("month")).agg(F.sum(cost).alias("spent"))
    return budgets.join(spent, key, "left").withColumn("used", F.try_divide("spent", "budget"))


def hot_keys(df: DataFrame, keys: list[str], more_than: int = 10, since: Column | None = None) -> DataFrame:
    """Keys with more than so many rows."""
    df = df.where(since) if since is not None else df
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > more_than)


def noisy_share(df: DataFrame, tenant: str, time_col: str, cpu_ms: str, mem_mb: str, *, bucket: str = "60 seconds", threshold: float = 0.4) -> DataFrame:
    """Each tenant's share of the cost cpu_ms + 10 * mem_mb of a time bucket, whether it is noisy, and its throttle (1: none)."""
    cost = df.groupBy(F.window(time_col, bucket)["start"].alias("bucket"), F.col(tenant).alias("tenant")).agg(F.sum(F.col(cpu_ms) + 10.0 * F.col(mem_mb)).alias("cost"))
    share = F.coalesce(F.try_divide("cost", F.sum("cost").over(Window.partitionBy("bucket"))), F.lit(0.0))
    excess = (F.col("share") - threshold) / (1 - threshold)
    return cost.withColumn("share", share).withColumn("noisy", F.col("share") > threshold).withColumn("throttle", F.when(F.col("noisy"), F.round(F.greatest(F.lit(0.0), 0.9 - 0.8 * excess), 3)).otherwise(1.0))


def centroid(df: DataFrame, vec: str, keys: list[str] | None = None) -> DataFrame:
    """The mean vector (of each group)."""
    keys = keys or []
    flat = df.select(*keys, F.posexplode(vec).alias("pos", "x")).groupBy(*keys, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return flat.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("centroid"))


def spread(df: DataFrame, vec: str, keys: list[str] | None = None) -> DataFrame:
    """Mean L2 distance to the centroid; 0 for fewer than two vectors."""
    from ..functions.vectors import l2_distance

    keys = keys or []
    c = centroid(df, vec, keys)
    joined = df.select(*keys, vec).join(F.broadcast(c) if not keys else c, keys or None)
    out = joined.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(l2_distance(F.col(vec), F.col("centroid"))).alias("d"))
    return out.select(*keys, F.when(F.col("n") < 2, 0.0).otherwise(F.col("d")).alias("spread"))


def medoid(df: DataFrame, vec: str, id_col: str, keys: list[str] | None = None) -> DataFrame:
    """The row nearest to the centroid; ties to the smaller id."""
    from ..functions.vectors import l2_distance

    keys = keys or []
    c = centroid(df, vec, keys)
    joined = df.select(*keys, id_col, vec).join(F.broadcast(c) if not keys else c, keys or None)
    return joined.groupBy(*keys).agg(F.min(F.struct(l2_distance(F.col(vec), F.col("centroid")).alias("d"), F.col(id_col).alias("id"))).alias("m")).select(*keys, F.col("m.id").alias(id_col), F.col("m.d").alias("distance"))
