"""Predicate lists as Column conjunctions."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Predicate = tuple[str, str, Any]


def predicate(column: str | Column, op: str, value: Any = None) -> Column:
    """One comparison with SQL's null semantics. LIKE keeps case, ILIKE doesn't; both match the whole value.

    NOT IN over a list with null is never true, as in SQL. BETWEEN takes (low, high), inclusive.
    """
    c = F.col(column) if isinstance(column, str) else column
    op = " ".join(op.upper().split())
    simple = {"=": c == value, "==": c == value, "!=": c != value, "<>": c != value} if value is not None and not isinstance(value, (list, tuple, set)) else {}
    if op in simple:
        return simple[op]
    if op in ("=", "==", "!=", "<>") and value is None:
        return F.lit(None).cast("boolean")
    if op in ("<", "<=", ">", ">="):
        return {"<": c.__lt__, "<=": c.__le__, ">": c.__gt__, ">=": c.__ge__}[op](value)
    if op == "IN":
        return c.isin(*value) if value else F.lit(False)
    if op in ("NOT IN", "NOT_IN"):
        return ~c.isin(*value) if value else F.lit(True)
    if op in ("LIKE", "ILIKE"):
        return c.like(value) if op == "LIKE" else c.ilike(value)
    if op in ("NOT LIKE", "NOT ILIKE"):
        return ~(c.like(value) if op == "NOT LIKE" else c.ilike(value))
    if op in ("IS NULL", "IS_NULL"):
        return c.isNull()
    if op in ("IS NOT NULL", "IS_NOT_NULL"):
        return c.isNotNull()
    if op == "BETWEEN":
        return c.between(*value)
    raise ValueError(f"unknown operator: {op}")


def conjunction(predicates: Iterable[Predicate], columns: list[str] | None = None) -> Column:
    """All of the predicates. With columns, predicates on others are left out."""
    chosen = [predicate(*p) for p in predicates if columns is None or p[0] in columns]
    return reduce(lambda a, b: a & b, chosen, F.lit(True))


def filter_rows(df: DataFrame, predicates: Iterable[Predicate], *, unknown: str = "error") -> DataFrame:
    """Rows that meet all predicates. unknown: what a predicate on a missing column does: error, skip it, or fail the row."""
    preds = list(predicates)
    missing = [p[0] for p in preds if p[0] not in df.columns]
    if missing and unknown == "fail":
        return df.where(F.lit(False))
    if missing and unknown != "skip":
        raise ValueError(f"no such column: {missing}")
    return df.where(conjunction(preds, df.columns))
