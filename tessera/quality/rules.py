"""The table of rules: for each kind its parameter, the aggregate it needs and when it holds.

A rule is a kind with a column, a limit (the parameter's value) and whether its failure blocks. Null values are skipped
by all rules but not_null and completeness; a regular expression has to match from the start of the value; min and max
of no values hold; completeness of no rows is 0; freshness of no values fails; naive timestamps count as UTC.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any, NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Kind(NamedTuple):
    parameter: str | None
    #: (column, limit) to an aggregate; None: not an aggregate of the table
    measure: Callable[[Column | None, Any], Column] | None
    #: (measure, limit) to whether the rule holds
    holds: Callable[[Any, Any], bool]
    #: what the measure is called in results
    measured: str = "violations"
    default: Any = None


def _none(value: Any, limit: Any) -> bool:
    return value == 0


def _text(c: Column) -> Column:
    return c.cast("string")


def _repeats(c: Column, _: Any) -> Column:
    """Rows less distinct values; nulls together count as one value."""
    return F.count("*") - F.count_distinct(c) - F.coalesce(F.max(c.isNull().cast("int")), F.lit(0))


def _outside(c: Column, values: list) -> Column:
    return F.count_if(~c.isin(*values)) if values else F.count(c)


#: Kinds and parameters as suite files name them. freshness measures the last time in microseconds, and its limit is compared with the age.
KINDS: dict[str, Kind] = {
    "not_null": Kind(None, lambda c, _: F.count_if(c.isNull()), _none),
    "unique": Kind(None, _repeats, _none),
    "min": Kind("min", lambda c, _: F.min(c), lambda x, least: x is None or x >= least, "actual_min"),
    "max": Kind("max", lambda c, _: F.max(c), lambda x, most: x is None or x <= most, "actual_max"),
    "min_length": Kind("min_length", lambda c, n: F.count_if(F.length(_text(c)) < n), _none),
    "max_length": Kind("max_length", lambda c, n: F.count_if(F.length(_text(c)) > n), _none),
    "regex": Kind("pattern", lambda c, p: F.count_if(~_text(c).rlike(f"^(?:{p})")), _none),
    "accepted_values": Kind("values", _outside, _none),
    "row_count_min": Kind("min_rows", lambda c, _: F.count("*"), lambda n, least: n >= least, "row_count"),
    "row_count_max": Kind("max_rows", lambda c, _: F.count("*"), lambda n, most: n <= most, "row_count"),
    "freshness": Kind("max_age_hours", lambda c, _: F.unix_micros(F.max(c).cast("timestamp")), lambda age, most: age is not None and age <= most, "age_hours"),
    "completeness": Kind("min_pct", lambda c, _: F.coalesce(F.try_divide(F.count(c) * 100.0, F.count("*")), F.lit(0.0)), lambda pct, least: pct >= least, "completeness_pct", 95.0),
    "custom_sql": Kind("sql", None, lambda x, _: x.strip().lower() not in ("", "false", "0") if isinstance(x, str) else bool(x), "value"),
}


class Rule(NamedTuple):
    kind: str
    column: str | None
    limit: Any
    name: str
    blocking: bool
    dataset: str

    @property
    def spec(self) -> Kind:
        return KINDS[self.kind]

    def aggregate(self) -> Column:
        if self.spec.measure is None:
            raise ValueError(f"{self.kind} has no aggregate")
        return self.spec.measure(F.col(f"`{self.column}`") if self.column else None, self.limit)


def rule(kind: str, column: str | None = None, limit: Any = None, *, name: str | None = None, blocking: bool = True, dataset: str = "") -> Rule:
    """A rule; named by kind and column, or limit where there is no column."""
    spec = KINDS.get(kind)
    if spec is None:
        raise ValueError(f"no rule {kind}")
    limit = spec.default if limit is None else limit
    if spec.parameter and limit is None:
        raise ValueError(f"{kind} needs {spec.parameter}")
    return Rule(kind, column, limit, name or f"{kind}_{limit if column is None else column}", blocking, dataset)


class Suite(NamedTuple):
    name: str
    dataset: str
    rules: tuple[Rule, ...]
    description: str = ""
