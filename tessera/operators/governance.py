"""Row-level security and column masking as views; anything that can't be applied closes the table."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RowPolicy:
    """Rows of `table` that a role in `roles` sees: those meeting `condition`, SQL with :tenant_id and :user_role."""

    table: str
    roles: tuple[str, ...]
    condition: str


@dataclass(frozen=True)
class MaskRule:
    """kind: full, partial (first_n and last_n stay), hash, null or custom (SQL over the column). pattern: a regular expression for whole column names."""

    pattern: str
    kind: str
    first_n: int = 0
    last_n: int = 0
    char: str = "*"
    expression: str | None = None
    exempt: tuple[str, ...] = ()
    priority: int = 100
    tables: tuple[str, ...] = field(default=())


def bind(condition: str, values: dict[str, Any]) -> str:
    """:name replaced by an escaped literal, outside quoted strings; an unknown name is an error."""

    def literal(v: Any) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).upper()
        return str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"

    def swap(m: re.Match) -> str:
        if m[1] is None:
            return m[0]
        if m[1] not in values:
            raise ValueError(f"no value for :{m[1]}")
        return literal(values[m[1]])

    return re.sub(r"'(?:[^'\\]|\\.)*'|(?<![:\w]):([A-Za-z_]\w*)", swap, condition)


def secured(df: DataFrame, table: str, policies: list[RowPolicy], role: str, values: dict[str, Any]) -> DataFrame:
    """The rows a role may see. Policies of its roles are alternatives; a table with policies but none for the role shows no rows."""
    own = [p for p in policies if p.table == table]
    if not own:
        return df
    mine = [p for p in own if role in p.roles]
    if not mine:
        return df.where(F.lit(False))
    values = {"user_role": role, **values}
    return df.where(" OR ".join(f"({bind(p.condition, values)})" for p in mine))


def mask(c: Column, rule: MaskRule) -> Column:
    """The masked value as text; null stays null. A partial mask of a text no longer than what it keeps masks all of it."""
    s = c.cast("string")
    n = F.length(s)
    if rule.kind == "full":
        return F.when(s.isNotNull(), F.repeat(F.lit(rule.char), n))
    if rule.kind == "partial":
        keep = rule.first_n + rule.last_n
        some = F.concat(F.substring(s, 1, rule.first_n) if rule.first_n else F.lit(""), F.repeat(F.lit(rule.char), n - keep), F.right(s, F.lit(rule.last_n)) if rule.last_n else F.lit(""))
        return F.when(n > keep, some).otherwise(F.repeat(F.lit(rule.char), n))
    if rule.kind == "hash":
        return F.sha2(s, 256)
    if rule.kind == "null":
        return F.lit(None).cast("string")
    raise ValueError(f"mask kind: {rule.kind}")


def masked(df: DataFrame, rules: list[MaskRule], role: str, table: str = "") -> DataFrame:
    """Columns masked by the first matching rule (by priority) that doesn't exempt the role."""
    out = {}
    for c in df.columns:
        fits = [r for r in rules if re.fullmatch(r.pattern, c, re.IGNORECASE) and (not r.tables or table in r.tables)]
        for r in sorted(fits, key=lambda r: r.priority):
            if role not in r.exempt:
                out[c] = F.expr(r.expression) if r.kind == "custom" else mask(F.col(f"`{c}`"), r)
            break
    return df.withColumns(out) if out else df


def open_views(spark: SparkSession, tables: dict[str, DataFrame], policies: list[RowPolicy], rules: list[MaskRule], role: str, values: dict[str, Any]) -> None:
    """A session's view of the tables: policies first, then masks, each table under its own name. A failure leaves an empty view."""
    for name, df in tables.items():
        try:
            view = masked(secured(df, name, policies, role, values), rules, role, name)
            _ = view.schema
        except Exception:
            df.where(F.lit(False)).createOrReplaceTempView(name)
            raise
        view.createOrReplaceTempView(name)
