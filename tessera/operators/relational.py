"""Joins, unions, merges, sorting and limits."""

from __future__ import annotations

import math
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Side of a broadcast join, at most, and the assumed bytes of a row for the skew decision.
BROADCAST_MB, ROW_BYTES = 100, 100


def join(left: DataFrame, right: DataFrame, on: list[str] | Column, how: str = "inner", hint: str | None = None) -> DataFrame:
    """Any join; hint (broadcast, merge, shuffle_hash, shuffle_replicate_nl) goes to the right side."""
    return left.join(right.hint(hint) if hint else right, on, how)


def join_strategy(left_rows: int, right_rows: int, distributed: bool = True) -> str:
    """A strategy by row counts, for plans that are reported rather than run; Catalyst and AQE decide for real ones."""
    if distributed and min(left_rows, right_rows) < 100_000:
        return "broadcast"
    return "merge" if max(left_rows, right_rows) > 1_000_000 else "hash"


def stitch_join(tables: list[DataFrame], keys: list[str], how: str = "inner") -> DataFrame:
    """Tables joined from left to right on keys; a column that both sides have is the first that isn't null."""

    def pair(a: DataFrame, b: DataFrame) -> DataFrame:
        both = [c for c in b.columns if c in a.columns and c not in keys]
        b = b.select(*[F.col(c).alias(f"{c}_right") if c in both else F.col(c) for c in b.columns])
        out = a.join(b, keys, how)
        spent = {f"{c}_right" for c in both}
        return out.select(*[F.coalesce(c, f"{c}_right").alias(c) if c in both else F.col(c) for c in out.columns if c not in spent])

    return reduce(pair, _with_rows(tables))


def _with_rows(tables: list[DataFrame]) -> list[DataFrame]:
    if not tables:
        raise ValueError("nothing to stitch")
    return tables


def union_by_name(tables: list[DataFrame], columns: list[str] | None = None) -> DataFrame:
    """UNION ALL by name: absent columns are null, a column's type is that of the first table that has it."""
    types = {f.name: f.dataType for t in reversed(tables) for f in t.schema}
    typed = [t.select(*[F.col(c).cast(types[c]).alias(c) for c in t.columns]) for t in _with_rows(tables)]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), typed)
    return out.select(*columns) if columns else out


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by the order columns."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def upsert(base: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of base without a match in fresh, and all of fresh; null keys match null keys."""
    k = fresh.select(*[F.col(c).alias(f"_{c}") for c in keys]).distinct()
    cond = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys])
    return base.join(k, cond, "left_anti").unionByName(fresh, allowMissingColumns=True)


def merge(tables: list[DataFrame], keys: list[str], order_by: str | None = None) -> DataFrame:
    """Later tables replace the keys of earlier ones; sorted by a column, latest first, if asked for."""
    out = reduce(lambda a, b: upsert(a, b, keys), _with_rows(tables))
    return out.orderBy(F.desc(order_by)) if order_by else out


def hybrid(recent: DataFrame, history: DataFrame, time_col: str, split: Any) -> DataFrame:
    """Rows since `split` from one source, earlier ones and those without a time from another, below whatever filters and aggregates follow."""
    at = split if isinstance(split, Column) else F.lit(split)
    return recent.where(F.col(time_col) >= at).unionByName(history.where((F.col(time_col) < at) | F.col(time_col).isNull()), allowMissingColumns=True)


def skew(df: DataFrame, key: str, share: float = 0.05) -> DataFrame:
    """Values of a key that hold at least `share` of all rows: (value, n, frequency)."""
    counts = df.groupBy(F.col(key).alias("value")).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("total"))  # one row
    return counts.join(F.broadcast(total)).withColumn("frequency", F.col("n") / F.col("total")).where(F.col("frequency") >= share).select("value", "n", "frequency")


def skew_factor(max_frequency: float, ndv: int) -> float:
    return max_frequency * ndv


def skew_plan(other_rows: int, factor: float) -> tuple[str, int]:
    """(broadcast | salt | none, number of salts)."""
    if other_rows * ROW_BYTES <= BROADCAST_MB * 1024 * 1024:
        return "broadcast", 1
    if factor >= 10:
        return "salt", min(64, max(2, math.ceil(factor / 2)))
    return "none", 1


def salted_join(big: DataFrame, small: DataFrame, key: str, salts: int = 8, how: str = "inner", spread: list[str] | None = None) -> DataFrame:
    """big joined with small by a skewed key: each key of big is dealt to `salts` tasks, small is copied to each.

    The salt is a hash of `spread` (by default all of big's columns), so a task that runs again deals alike.
    how: inner, left, left_semi or left_anti.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("rows of the copied side would repeat")
    a = big.withColumn("_salt", F.pmod(F.xxhash64(*(spread or big.columns)), F.lit(salts)))
    b = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return a.join(b, [key, "_salt"], how).drop("_salt")


def range_join(left: DataFrame, right: DataFrame, at: str, start: str, end: str, width: float, how: str = "inner") -> DataFrame:
    """Rows with start <= at < end, by equal buckets of `width` instead of a nested loop; numbers or timestamps in seconds."""
    a = left.withColumn("_b", F.floor(F.col(at).cast("double") / width))
    b = right.withColumn("_b", F.explode(F.sequence(F.floor(F.col(start).cast("double") / width), F.floor(F.col(end).cast("double") / width))))
    return a.join(b, (a["_b"] == b["_b"]) & (F.col(at) >= F.col(start)) & (F.col(at) < F.col(end)), how).drop("_b")


def asof_join(left: DataFrame, right: DataFrame, by: list[str], at: str, right_at: str) -> DataFrame:
    """Each left row with the last right row of the same `by` that isn't later: a union and one window, no pairs."""
    cols = [c for c in right.columns if c not in by]
    a = left.select("*", F.lit(None).cast(right.select(F.struct(*cols).alias("s")).schema["s"].dataType).alias("_r"), F.col(at).alias("_t"), F.lit(1).alias("_side"))
    b = right.select(*[F.col(c) if c in by else F.lit(None).cast(t).alias(c) for c, t in left.dtypes], F.struct(*cols).alias("_r"), F.col(right_at).alias("_t"), F.lit(0).alias("_side"))
    w = Window.partitionBy(*by).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = a.unionByName(b).withColumn("_r", F.last("_r", ignorenulls=True).over(w)).where("_side = 1")
    return out.select(*left.columns, *[F.col(f"_r.{c}").alias(c) for c in cols])


def top_k(df: DataFrame, k: int, *order: Column | str) -> DataFrame:
    """The first k rows; a heap per task, no full sort."""
    return df.orderBy(*order).limit(k)


def page(df: DataFrame, order: list[Column | str], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def pareto(df: DataFrame, *costs: str) -> DataFrame:
    """Rows that no other row beats in all costs (smaller is better), for small tables of choices."""
    o = df.select(*[F.col(c).alias(f"_{c}") for c in costs])
    no_worse = reduce(lambda a, b: a & b, [F.col(f"_{c}") <= F.col(c) for c in costs])
    better = reduce(lambda a, b: a | b, [F.col(f"_{c}") < F.col(c) for c in costs])
    return df.join(o, no_worse & better, "left_anti")
