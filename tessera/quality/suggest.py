"""Rules and anomalies read off a profile: deterministic, without any service."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, StringType, TimestampNTZType, TimestampType

from ..operators.aggregates import profile
from .rules import Suite, rule


def suggest(df: DataFrame, name: str, urn: str = "", *, few: int = 20, max_age_hours: float = 24.0) -> Suite:
    """A suite that the present data meets (freshness apart): what is never null, unique, bounded, or one of a few values."""
    rules = []
    rows = {r["column"]: r for r in profile(df).collect()}  # one row per column
    n = next((r.n for r in rows.values()), 0)
    if n:
        rules.append(rule("row_count_min", limit=1))
    exact = df.agg(*[F.count_distinct(F.col(f"`{c}`")).alias(f"d{k}") for k, c in enumerate(rows)]).first() if rows else []
    low = [c for (c, r), d in zip(rows.items(), exact, strict=True) if isinstance(df.schema[c].dataType, StringType) and 0 < d <= few and d < n]
    sets = df.agg(*[F.array_sort(F.collect_set(F.col(f"`{c}`"))).alias(c) for c in low]).first() if low else None
    for (c, r), d in zip(rows.items(), exact, strict=True):
        kind = df.schema[c].dataType
        if not n:
            break
        if r.nulls == 0:
            rules.append(rule("not_null", c))
        elif r.null_fraction < 0.5:
            rules.append(rule("completeness", c, float(int((1 - r.null_fraction) * 100)), blocking=False))
        if r.nulls == 0 and d == n and n > 1:
            rules.append(rule("unique", c))
        if isinstance(kind, NumericType) and r.min is not None:
            rules.append(rule("min", c, float(r.min), blocking=False))
            rules.append(rule("max", c, float(r.max), blocking=False))
        if c in low:
            rules.append(rule("accepted_values", c, list(sets[c]), blocking=False))
        if isinstance(kind, (DateType, TimestampType, TimestampNTZType)):
            rules.append(rule("freshness", c, max_age_hours, blocking=False))
    return Suite(name, urn, tuple(rules), "suggested from a profile")


def anomalies(df: DataFrame, z: float = 3.0, nulls: float = 0.5) -> DataFrame:
    """(column, kind, value): columns that are mostly null or constant, and numbers with rows beyond z deviations of the mean. Two passes."""
    p = profile(df).collect()
    spark, found = df.sparkSession, []
    numbers = [r for r in p if r["stddev"] and r["stddev"] > 0]
    far = df.agg(*[F.count_if(F.abs(F.col(f"`{r['column']}`") - r["mean"]) > z * r["stddev"]).alias(f"o{k}") for k, r in enumerate(numbers)]).first() if numbers else []
    for r in p:
        if r.n and r.null_fraction > nulls:
            found.append((r["column"], "mostly_null", float(r.null_fraction)))
        if r.n > 1 and r.ndv == 1 and r.nulls == 0:
            found.append((r["column"], "constant", 1.0))
    found += [(r["column"], "outliers", float(o)) for r, o in zip(numbers, far, strict=True) if o]
    return spark.createDataFrame(found, "column string, kind string, value double")
