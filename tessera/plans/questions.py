"""Plain-English questions to Spark SQL, by rules."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_AGG = {"count": "count", "how many": "count", "number of": "count", "total": "sum", "sum": "sum", "average": "avg", "avg": "avg", "mean": "avg", "minimum": "min", "min": "min", "lowest": "min", "maximum": "max", "max": "max", "highest": "max", "median": "median"}
_STOP = {"the", "a", "an", "of", "by", "per", "for", "in", "on", "with", "and", "or", "is", "are", "show", "me", "list", "all", "what", "which", "each", "from", "to", "give", "top", "last", "this", "than", "more", "less", "where"}
_COMPARE = [(r"(?:at least|>=)", ">="), (r"(?:at most|<=)", "<="), (r"(?:greater than|more than|above|over|exceeding|>)", ">"), (r"(?:less than|fewer than|below|under|<)", "<"), (r"(?:equal to|equals|=|is)", "=")]


@dataclass
class Question:
    text: str
    intent: str = "select"
    tables: list[str] = field(default_factory=list)
    aggregates: list[tuple[str, str]] = field(default_factory=list)
    group_by: list[str] = field(default_factory=list)
    filters: list[tuple[str, str, str]] = field(default_factory=list)
    period: str | None = None
    order: str = "DESC"
    limit: int | None = None


def _words(text: str) -> list[str]:
    return re.findall(r"[a-z_][a-z0-9_]*", text.lower())


def _stem(w: str) -> str:
    return w[:-3] + "y" if w.endswith("ies") else w[:-1] if w.endswith("s") and not w.endswith("ss") else w


def discover(text: str, tables: dict[str, list[str]], most: int = 5) -> list[str]:
    """Tables by how many of the question's words their name and columns share; those without any are left out."""
    asked = {_stem(w) for w in _words(text) if w not in _STOP}
    score = {}
    for t, cols in tables.items():
        name, parts = {_stem(p) for p in t.lower().split("_")} | {_stem(t.lower())}, {_stem(p) for c in cols for p in c.lower().split("_")} | {_stem(c.lower()) for c in cols}
        score[t] = 2 * len(asked & name) + len(asked & parts)
    return [t for t, s in sorted(score.items(), key=lambda x: (-x[1], x[0])) if s][:most]


def _column(phrase: str, cols: list[str]) -> str | None:
    """The column that a phrase names: by its full name, or by all of the words of a column after its prefix."""
    words = [_stem(w) for w in _words(phrase)]
    by_len = sorted(cols, key=lambda c: (-len(c), c))
    for c in by_len:
        if c.lower() in phrase.lower().split():
            return c
    for c in by_len:
        parts = [_stem(p) for p in c.lower().split("_") if len(p) > 1]
        if parts and (all(p in words for p in parts) or "".join(parts) in ("".join(words), *words)):
            return c
    return next((c for c in by_len if any(len(w) > 3 and w in c.lower() for w in words)), None)


def parse(text: str, tables: dict[str, list[str]]) -> Question:
    """What a question asks of the given tables (name -> columns)."""
    low, q = text.lower().strip(" ?."), Question(text)
    q.tables = discover(text, tables, 1)
    cols = tables[q.tables[0]] if q.tables else []
    for word, fn in _AGG.items():
        if m := re.search(rf"\b{word}\b(?:\s+(?:of\s+)?(?:the\s+)?([a-z_ ]+?))?(?=\s+(?:by|per|for|in|where|with|since|last|this|above|over|below|under|more|less|at)\b|$)", low):
            col = _column(m[1] or "", cols) if fn != "count" else None
            if fn == "count" or col:
                q.aggregates.append((fn, col or "*"))
                break
    if m := re.search(r"\b(?:by|per|for each|grouped by)\s+([a-z_ ]+?)(?=\s+(?:where|with|since|last|this|above|over|order|top|in)\b|$)", low):
        q.group_by = [c for p in re.split(r"\band\b|,", m[1]) if (c := _column(p, cols))]
    for c in sorted(cols, key=len, reverse=True):
        label = "[ _]".join(p for p in c.lower().split("_") if len(p) > 1) or c
        for p, op in _COMPARE:
            if m := re.search(rf"\b{label}\s+(?:is\s+)?{p}\s*('[^']*'|-?\d+(?:\.\d+)?)", low):
                q.filters.append((c, op, m[1]))
                break
    if m := re.search(r"\b(today|yesterday|this (?:week|month|quarter|year)|last \d+ (?:day|week|month|year)s?)\b", low):
        q.period = m[1]
    if m := re.search(r"\b(?:top|bottom|first)\s+(\d+)|\b(?:show|give|list|display)\s+(?:me\s+)?(\d+)", low):
        q.limit = int(m[1] or m[2])
    q.order = "ASC" if re.search(r"\b(?:bottom|lowest|least|smallest|worst|fewest)\b", low) else "DESC"
    score = {"describe": len(re.findall(r"\b(?:describe|schema|structure|columns)\b", low)), "compare": len(re.findall(r"\b(?:compare|versus|vs|difference)\b", low)), "top_n": len(re.findall(r"\b(?:top|bottom|best|worst)\b", low)), "aggregate": len(q.aggregates), "filter": len(q.filters), "select": 0}
    q.intent = max(score, key=lambda k: (score[k], k == "select"))
    return q


def to_sql(q: Question, time_col: str | None = None) -> str:
    """Spark SQL for a parsed question; its period applies to time_col."""
    if not q.tables:
        raise ValueError("no table fits the question")
    if q.intent == "describe":
        return f"DESCRIBE TABLE {q.tables[0]}"
    aggs = [f"{fn}({col}) AS {fn}_{'rows' if col == '*' else col}" for fn, col in q.aggregates]
    where = [f"{c} {op} {v}" for c, op, v in q.filters]
    if q.period and time_col:
        if q.period in ("today", "yesterday"):
            where.append(f"to_date({time_col}) = current_date()" + (" - INTERVAL 1 DAY" if q.period == "yesterday" else ""))
        elif q.period.startswith("this "):
            where.append(f"{time_col} >= date_trunc('{q.period[5:]}', current_date())")
        else:
            _, n, unit = q.period.split()
            where.append(f"{time_col} >= current_date() - INTERVAL {n} {unit.rstrip('s').upper()}")
    sql = f"SELECT {', '.join([*q.group_by, *aggs]) or '*'} FROM {q.tables[0]}"
    sql += f" WHERE {' AND '.join(where)}" if where else ""
    sql += f" GROUP BY {', '.join(q.group_by)}" if q.group_by and aggs else ""
    if aggs and q.group_by:
        sql += f" ORDER BY {aggs[0].split(' AS ')[1]} {q.order}, {', '.join(q.group_by)}"
    return sql + (f" LIMIT {q.limit}" if q.limit else "")
