"""Scalar functions: SQL normalisation, fingerprints, relative dates, text similarity."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Other dialects' unit names for date truncation.
UNITS = {"YYYY": "year", "YEAR": "year", "Y": "year", "Q": "quarter", "MM": "month", "MON": "month", "MONTH": "month", "IW": "week", "WW": "week", "W": "week", "DD": "day", "DDD": "day", "D": "day", "HH": "hour", "HH24": "hour", "MI": "minute", "SS": "second"}


def date_trunc(unit: str, ts: Column) -> Column:
    return F.date_trunc(UNITS.get(unit.upper(), unit.lower()), ts)


def relative_range(text: str, today: Column | None = None) -> tuple[Column, Column]:
    """[from, to) dates of today, yesterday, this week, month, quarter or year, and last N days, weeks, months or years."""
    today = F.current_date() if today is None else today
    t = text.lower().strip()
    if t == "today":
        return today, F.date_add(today, 1)
    if t == "yesterday":
        return F.date_sub(today, 1), today
    if m := re.fullmatch(r"this (week|month|quarter|year)", t):
        return F.trunc(today, m[1]), F.date_add(today, 1)
    if m := re.fullmatch(r"last (\d+) (day|week|month|year)s?", t):
        n = int(m[1])
        start = {"day": F.date_sub(today, n), "week": F.date_sub(today, 7 * n), "month": F.add_months(today, -n), "year": F.add_months(today, -12 * n)}[m[2]]
        return start, F.date_add(today, 1)
    raise ValueError(f"no such range: {text}")


_STEPS = [(r"'(?:[^']|'')*'", "?"), (r"\b\d+\.\d+\b", "?"), (r"\b\d+\b", "?"), (r"(?i)\bIN\s*\(\s*\?(?:\s*,\s*\?)*\s*\)", "IN (?)"), (r"\s+", " ")]


def normalise_sql(text: str) -> str:
    """A statement without its literals, IN lists as one, single spaces, upper case."""
    for p, r in _STEPS:
        text = re.sub(p, r, text)
    return text.strip().rstrip(";").strip().upper()


def fingerprint(text: str) -> str:
    """SHA-256 of the normalised statement: equal for statements that differ in literals alone."""
    return hashlib.sha256(normalise_sql(text).encode()).hexdigest()


def normalise_sql_col(c: Column) -> Column:
    """normalise_sql for a column of statements."""
    for p, r in _STEPS:
        c = F.regexp_replace(c, p, r)
    return F.upper(F.trim(F.regexp_replace(F.trim(c), r"[;\s]+$", "")))


def fingerprint_col(c: Column) -> Column:
    return F.sha2(normalise_sql_col(c), 256)


def regex_from_start(c: Column, pattern: str) -> Column:
    """Whether the pattern matches at the start of the value."""
    return c.cast("string").rlike(f"^(?:{pattern})")


def character_ratio(a: Column, b: Column) -> Column:
    """Share of equal characters by place, of the longer text; 1 for two empty texts."""
    x, y = F.split(a, ""), F.split(b, "")
    same = F.size(F.filter(F.zip_with(x, y, lambda p, q: (p == q) & (p != "")), lambda e: F.coalesce(e, F.lit(False))))
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(same / longer)


def edit_ratio(a: Column, b: Column) -> Column:
    """1 - Levenshtein distance / length of the longer text."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longer)
