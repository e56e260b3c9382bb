"""Analytics over logs and statistics: drift, workload, advice, comparison and risk."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def psi(reference: DataFrame, current: DataFrame, col: str, buckets: int = 10) -> float:
    """Population stability index over equal-width buckets of the reference's range (its upper edge closed).

    Values outside the range count in the denominator alone; empty buckets count as 1e-4. Over 0.1: drift. A
    reference without spread or values: 0.
    """
    lo, hi = reference.agg(F.min(col), F.max(col)).first()
    if lo is None or lo == hi:
        return 0.0
    a, b = (psi_buckets(df, col, float(lo), float(hi), buckets) for df in (reference, current))
    return float(a.join(b.toDF("bucket", "share_b"), "bucket").agg(F.sum((F.col("share_b") - F.col("share")) * F.log(F.col("share_b") / F.col("share")))).first()[0])


def psi_buckets(df: DataFrame, col: str, lo: float, hi: float, buckets: int = 10) -> DataFrame:
    """(bucket from 1, share of all rows with a value, at least 1e-4)."""
    x = F.col(col).cast("double")
    at = F.when(x == hi, buckets).otherwise(F.width_bucket(x, F.lit(lo), F.lit(hi), F.lit(buckets)))
    counts = df.where(x.isNotNull()).groupBy(at.alias("bucket")).agg(F.count("*").alias("n"))
    counts = counts.withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(0))))  # one row per bucket
    all_ = df.sparkSession.range(1, buckets + 1).select(F.col("id").alias("bucket"))
    share = F.coalesce(F.when(F.col("n") > 0, F.col("n") / F.col("total")), F.lit(1e-4))
    return all_.join(counts, "bucket", "left").select("bucket", F.greatest(share, F.lit(1e-4)).alias("share"))


def drift_scores(reference: DataFrame, current: DataFrame, cols: list[str], threshold: float = 0.1) -> dict[str, tuple[float, bool]]:
    return {c: (s := psi(reference, current, c), s > threshold) for c in cols}


def concept_drift(reference: DataFrame, current: DataFrame, error: str) -> dict[str, float | bool]:
    """Whether mean error grew by over 15 percent and the difference is significant at 5 percent (Welch's t, normal tail)."""
    (n1, m1, v1), (n2, m2, v2) = (df.agg(F.count(error), F.avg(error), F.var_samp(error)).first() for df in (reference, current))
    if min(n1, n2) < 2:
        return {"t": 0.0, "p": 1.0, "drift": False}
    se = math.sqrt(v1 / n1 + v2 / n2)
    t = (m2 - m1) / se if se else (math.inf if m2 != m1 else 0.0)
    p = math.erfc(abs(t) / math.sqrt(2))
    return {"t": t, "p": p, "drift": p < 0.05 and m2 > 1.15 * m1}


def performance_drift(reference: DataFrame, current: DataFrame, value: str, p: float = 0.95, growth: float = 0.2) -> DataFrame:
    """One row: both percentiles, their ratio, and whether it grew by more than `growth`."""
    a = reference.agg(F.percentile(value, p).alias("reference"))
    b = current.agg(F.percentile(value, p).alias("current"))
    return a.join(F.broadcast(b)).withColumn("ratio", F.try_divide("current", "reference")).withColumn("drift", F.col("ratio") > 1 + growth)


def content_hash(df: DataFrame) -> DataFrame:
    """One row: (n, hash), the same for the same rows in any order."""
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("hash"))


def compare(a: DataFrame, b: DataFrame) -> bool:
    """Whether two results hold the same rows."""
    return content_hash(a).first() == content_hash(b).first()


def ab_summary(runs: DataFrame, variant: str, ms: str, result_hash: str) -> DataFrame:
    """By variant: runs, mean, p50, p95 (by place, without interpolation) and the most frequent result."""
    from .aggregates import index_percentile

    return runs.groupBy(variant).agg(F.count("*").alias("runs"), F.avg(ms).alias("mean_ms"), index_percentile(ms, 0.5).alias("p50_ms"), index_percentile(ms, 0.95).alias("p95_ms"), F.mode(result_hash, True).alias("result"))


def ab_winner(summary: DataFrame, variant: str, a: str, b: str, margin: float = 0.95) -> str | None:
    """The variant whose mean is under `margin` of the other's, if both give one result; else None."""
    rows = {r[variant]: r for r in summary.where(F.col(variant).isin(a, b)).collect()}
    if len(rows) < 2 or rows[a]["result"] != rows[b]["result"]:
        return None
    if rows[b].mean_ms < margin * rows[a].mean_ms:
        return b
    return a if rows[a].mean_ms < margin * rows[b].mean_ms else None


def workload_profile(log: DataFrame, ms: str = "ms", joins: str = "joins", aggs: str = "aggs") -> DataFrame:
    """One row: queries, mean, p95, shares (percent) with joins (over 2), with aggregates and with neither."""
    pct = lambda c: (F.avg(F.when(c, 100.0).otherwise(0.0)))
    return log.agg(F.count("*").alias("queries"), F.avg(ms).alias("avg_ms"), F.percentile(ms, 0.95).alias("p95_ms"), pct(F.col(joins) > 2).alias("join_heavy_pct"), pct(F.col(aggs) > 0).alias("agg_heavy_pct"), pct((F.col(joins) == 0) & (F.col(aggs) == 0)).alias("filter_only_pct"))


def top_tables(log: DataFrame, tables: str = "tables", n: int = 10) -> DataFrame:
    return log.select(F.explode(tables).alias("table")).groupBy("table").agg(F.count("*").alias("queries")).orderBy(F.desc("queries"), "table").limit(n)


def performance_features(log: DataFrame, keys: list[str], ms: str, ok: Column, cached: Column, ts: str) -> DataFrame:
    """By key: count, mean, p50, p95, p99, success and cache-hit rates, last time: one aggregate."""
    return log.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(ms).alias("avg_ms"), *[F.percentile(ms, p).alias(f"p{int(p * 100)}_ms") for p in (0.5, 0.95, 0.99)], F.avg(F.when(ok, 1.0).otherwise(0.0)).alias("success_rate"), F.avg(F.when(cached, 1.0).otherwise(0.0)).alias("cache_hit_rate"), F.max(ts).alias("last_seen"))


def index_advice(log: DataFrame, table: str, column: str, ms: str, least: int = 5) -> DataFrame:
    """Filter columns by benefit, frequency x mean duration: candidates to sort or bucket files by."""
    return log.groupBy(table, column).agg(F.count("*").alias("queries"), F.avg(ms).alias("avg_ms")).where(F.col("queries") >= least).withColumn("benefit", F.col("queries") * F.col("avg_ms")).orderBy(F.desc("benefit"), table, column)


def partition_advice(column: str, dtype: str, ndv: int, rows: int) -> str | None:
    """range for times, list for up to 100 values, hash for keys of large tables (over 10 million rows), else None."""
    name = column.lower()
    if dtype.startswith(("date", "timestamp")) or name.endswith(("_at", "_date", "_time")):
        return "range"
    if 1 < ndv <= 100:
        return "list"
    return "hash" if rows > 10_000_000 and (name.endswith(("_id", "key")) or ndv > rows * 0.1) else None


def view_advice(log: DataFrame, fingerprint: str, ms: str, has_agg: str, least: int = 2) -> DataFrame:
    """Repeated aggregate statements by the time that a materialised result would save."""
    return log.where(F.col(has_agg)).groupBy(fingerprint).agg(F.count("*").alias("queries"), F.avg(ms).alias("avg_ms")).where(F.col("queries") >= least).withColumn("saved_ms", (F.col("queries") - 1) * F.col("avg_ms")).orderBy(F.desc("saved_ms"), fingerprint)


def replay_totals(replay: DataFrame, kind: str, before: str, after: str) -> DataFrame:
    """What a simulated change does to the recorded queries, by kind."""
    return replay.groupBy(kind).agg(F.count("*").alias("queries"), F.sum(before).alias("before_ms"), F.sum(after).alias("after_ms"), F.count_if(F.col(after) < F.col(before)).alias("faster"), F.count_if(F.col(after) > F.col(before)).alias("slower")).withColumn("change_pct", F.try_divide((F.col("after_ms") - F.col("before_ms")) * 100.0, "before_ms"))


#: Least gain of a learnt rule, as a share.
GAINS = {"join_order": 0.20, "pushdown": 0.30, "engine_affinity": 0.25}


def learnt_rules(log: DataFrame, shape: str, choice: str, ms: str, kind: str = "engine_affinity", least: int = 3) -> DataFrame:
    """For each query shape the fastest choice, if it beats the mean of the others by the kind's gain."""
    by = log.groupBy(shape, choice).agg(F.count("*").alias("n"), F.avg(ms).alias("avg_ms")).where(F.col("n") >= least)
    w = Window.partitionBy(shape)
    ranked = by.withColumn("rn", F.row_number().over(w.orderBy("avg_ms", choice))).withColumn("others", (F.sum("avg_ms").over(w) - F.col("avg_ms")) / (F.count("*").over(w) - 1 + F.when(F.count("*").over(w) == 1, 1).otherwise(0)))
    return ranked.where((F.col("rn") == 1) & (F.col("others") > 0)).withColumn("gain", 1 - F.col("avg_ms") / F.col("others")).where(F.col("gain") >= GAINS[kind]).select(shape, choice, "n", "avg_ms", "gain")


def regret_weights(decisions: DataFrame, key: str, order: list[str], predicted: str, actual: str, rate: float = 0.1, floor: float = 0.01) -> DataFrame:
    """By key: mean and total regret max(0, actual - predicted), and the weight after w = max(floor, w * exp(-rate * regret)) from 1.

    Regret is never negative, so weights only fall and the floor need be applied just at the end: a sum suffices.
    """
    regret = F.greatest(F.lit(0.0), F.col(actual) - F.col(predicted))
    return decisions.groupBy(key).agg(F.count("*").alias("n"), F.sum(regret).alias("cumulative_regret"), F.avg(regret).alias("average_regret")).withColumn("weight", F.greatest(F.lit(floor), F.exp(-rate * F.col("cumulative_regret"))))


def staleness(tables: DataFrame, rows: str, changes: str, age_hours: str, *, share: float = 0.1, least: int = 1000, oldest: float = 168.0) -> DataFrame:
    """Whether statistics are stale and how urgent they are; age null: never analysed."""
    n = F.greatest(F.col(rows), F.lit(1))
    ratio = F.col(changes) / n
    age = F.coalesce(age_hours, F.lit(999.0))
    stale = ((ratio >= share) & (F.col(changes) >= least)) | F.col(age_hours).isNull() | (age > oldest)
    priority = 0.6 * ratio + 0.2 * F.log2(F.greatest(n, F.lit(2)).cast("double")) / 30 + 0.2 * F.least(age / oldest, F.lit(1.0))
    return tables.withColumn("ratio", ratio).withColumn("is_stale", stale).withColumn("priority", F.when(F.col("is_stale"), priority).otherwise(0.0))


def sla_risk(p95: Column, complexity: Column, target: Column) -> Column:
    """safe, at_risk (over 80 percent of the target) or breach, with p95 scaled up to 1.5 times for complexity over 5."""
    x = p95 * (1 + F.greatest(F.lit(0), complexity - 5) / 10)
    return F.when(x > target, "breach").when(x > 0.8 * target, "at_risk").otherwise("safe")


def source_score(cost: Column, staleness_s: Column, load: Column) -> Column:
    """Lower is better: cost, ten times staleness (hours), load in percent."""
    return cost + 10 * staleness_s / 3600 + load


def choose_engine(rows: float, joins: int, aggregates: int) -> str:
    """cluster for a million rows, five joins or ten aggregates; else local."""
    return "cluster" if rows >= 1_000_000 or joins >= 5 or aggregates >= 10 else "local"


#: Dollars for a scanned terabyte, by kind of store.
SCAN_PRICE = {"object_store": 5.0, "warehouse": 6.25, "local": 0.0}


def scan_price(bytes_scanned: float, kind: str = "object_store") -> float:
    return bytes_scanned / 1e12 * SCAN_PRICE[kind]


def fair_next(queues: dict[str, dict], running: dict[str, float]) -> str | None:
    """The tenant whose query goes next: the least virtual time / weight, plus 0.01 x priority.

    queues: tenant -> {"waiting": n, "weight": w, "priority": p}; running: tenant -> virtual time used.
    """
    waiting = {t: q for t, q in queues.items() if q.get("waiting")}
    return min(sorted(waiting), key=lambda t: running.get(t, 0.0) / waiting[t].get("weight", 1.0) + 0.01 * waiting[t].get("priority", 5), default=None)


def failover(sources: DataFrame, region: str) -> DataFrame:
    """Healthy sources, those of the region first, then by latency."""
    return sources.where("healthy").orderBy((F.col("region") != region).cast("int"), "latency_ms", "name")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
