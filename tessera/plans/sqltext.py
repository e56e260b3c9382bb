"""Statements as text: other dialects' forms, FILTER in windows, opt-in approximations, and advice. Literals and comments are never touched."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from ..functions.scalars import UNITS, fingerprint

_OPAQUE = re.compile(r"'(?:[^']|'')*'|--[^\n]*|/\*.*?\*/", re.DOTALL)


def outside(text: str, change: Callable[[str], str]) -> str:
    """change() applied to what isn't a string or comment, which stand as placeholders meanwhile."""
    kept: list[str] = []

    def hide(m: re.Match) -> str:
        kept.append(m[0])
        return f"\x00{len(kept) - 1}\x00"

    out = change(_OPAQUE.sub(hide, text))
    return re.sub(r"\x00(\d+)\x00", lambda m: kept[int(m[1])], out)


def close(text: str, at: int) -> int:
    """Place of the parenthesis that closes the one at `at`."""
    level = 0
    for k in range(at, len(text)):
        level += (text[k] == "(") - (text[k] == ")")
        if level == 0:
            return k
    raise ValueError("unbalanced parentheses")


def arguments(text: str) -> list[str]:
    """Arguments between a call's parentheses."""
    out, level, last = [], 0, 0
    for k, c in enumerate(text):
        level += (c == "(") - (c == ")")
        if c == "," and level == 0:
            out.append(text[last:k].strip())
            last = k + 1
    return [*out, text[last:].strip()] if text.strip() else []


def calls(text: str, name: str, change: Callable[[list[str]], str | None]) -> str:
    """Calls of a function replaced by change(arguments); None leaves one as it is."""
    at = 0
    while m := re.compile(rf"\b{name}\s*\(", re.IGNORECASE).search(text, at):
        end = close(text, m.end() - 1)
        new = change(arguments(text[m.end() : end]))
        if new is None:
            at = m.end()
        else:
            text = text[: m.start()] + new + text[end + 1 :]
            at = m.start() + len(new)
    return text


def to_spark(text: str) -> str:
    """Common forms of other dialects in Spark SQL: date truncation, NOW, GETDATE, DATEADD, DATE_DIFF, FETCH FIRST, APPROX_DISTINCT, LISTAGG of lists."""
    quoted: dict[str, str] = {}

    def unit(u: str) -> str:
        raw = quoted.get(u, u).strip("'").upper()
        return f"'{UNITS.get(raw, raw.lower())}'"

    def is_unit(u: str) -> bool:
        raw = quoted.get(u, u).strip("'").upper()
        return raw in UNITS or raw in ("WEEK", "DAY", "HOUR", "MINUTE", "SECOND", "QUARTER")

    def change(t: str) -> str:
        t = calls(t, "DATE_TRUNC", lambda a: f"date_trunc({unit(a[0])}, {a[1]})" if len(a) == 2 and is_unit(a[0]) else f"date_trunc({unit(a[1])}, {a[0]})" if len(a) == 2 else None)
        t = calls(t, "TRUNC", lambda a: f"date_trunc({unit(a[1])}, {a[0]})" if len(a) == 2 and is_unit(a[1]) else None)
        t = calls(t, "DATEADD", lambda a: f"dateadd({quoted.get(a[0], a[0]).strip(chr(39)).lower()}, {a[1]}, {a[2]})" if len(a) == 3 else None)
        t = calls(t, "DATE_DIFF", lambda a: f"datediff({quoted.get(a[0], a[0]).strip(chr(39)).lower()}, {a[1]}, {a[2]})" if len(a) == 3 else None)
        t = calls(t, "APPROX_DISTINCT", lambda a: f"approx_count_distinct({', '.join(a)})")
        t = calls(t, "APPROX_PERCENTILE", lambda a: f"approx_percentile({', '.join(a)})")
        t = re.sub(r"\b(?:NOW|GETDATE|SYSDATE)\s*\(\s*\)", "current_timestamp()", t, flags=re.IGNORECASE)
        return re.sub(r"\bFETCH\s+FIRST\s+(\d+)\s+ROWS?\s+ONLY\b", r"LIMIT \1", t, flags=re.IGNORECASE)

    strings = _OPAQUE.findall(text)
    quoted.update({f"\x00{k}\x00": s for k, s in enumerate(strings)})
    return outside(text, change)


def filter_in_window(text: str) -> str:
    """agg(x) FILTER (WHERE c) OVER ... as agg(CASE WHEN c THEN x END) OVER ..., which Spark accepts; count(*) counts 1."""

    def change(t: str) -> str:
        at = 0
        while m := re.compile(r"\)\s*FILTER\s*\(\s*WHERE\b", re.IGNORECASE).search(t, at):
            opened = t.index("(", m.start() + 1)
            end = close(t, opened)
            if not re.match(r"\s*OVER\b", t[end + 1 :], re.IGNORECASE):
                at = end
                continue
            cond = t[m.end() : end].strip()
            start, level = m.start(), 0
            for k in range(m.start(), -1, -1):
                level += (t[k] == ")") - (t[k] == "(")
                if level == 0:
                    start = k
                    break
            arg = t[start + 1 : m.start()].strip()
            new = f"(CASE WHEN {cond} THEN {'1' if arg == '*' else arg} END)"
            t = t[:start] + new + t[end + 1 :]
            at = start + len(new)
        return t

    return outside(text, change)


def approximate(text: str) -> str:
    """COUNT(DISTINCT x) of one column as approx_count_distinct(x): a choice of the caller, results differ."""
    return outside(text, lambda t: re.sub(r"\bCOUNT\s*\(\s*DISTINCT\s+([\w.`]+)\s*\)", r"approx_count_distinct(\1)", t, flags=re.IGNORECASE))


def with_limit(text: str, n: int = 1000) -> str:
    """The statement with a LIMIT if it has none and doesn't aggregate."""
    bare = _OPAQUE.sub("", text)
    if re.search(r"\bLIMIT\b|\bGROUP\s+BY\b|\b(?:COUNT|SUM|AVG|MIN|MAX)\s*\(", bare, re.IGNORECASE) or not re.match(r"\s*(?:SELECT|WITH)\b", bare, re.IGNORECASE):
        return text
    return f"{text.rstrip().rstrip(';')} LIMIT {n}"


@dataclass(frozen=True)
class Advice:
    rule: str
    message: str
    rewritten: str | None = None
    gain_pct: float = 0.0
    confidence: str = "medium"


def advise(text: str, columns: dict[str, list[str]] | None = None) -> list[Advice]:
    """Doubtful patterns of a statement. A rewrite is given only where it keeps the result.

    columns: table -> columns, to name them instead of *.
    """
    bare, out = _OPAQUE.sub(lambda m: m[0] if m[0].startswith("'") else " ", text), []
    find = lambda p: re.search(p, bare, re.IGNORECASE | re.DOTALL)
    if m := find(r"\bSELECT\s+\*\s+FROM\s+(\w+)"):
        names = (columns or {}).get(m[1])
        if names is None or len(names) > 3:
            new = re.sub(r"(?i)SELECT\s+\*", f"SELECT {', '.join(names)}", text, count=1) if names and "JOIN" not in bare.upper() else None
            out.append(Advice("select_star", "name the columns you need", new, min(80.0, 10.0 + 5.0 * len(names or [0] * 10)), "high"))
    if (m := find(r"\bFROM\s+(\w+)\s*,\s*(\w+)")) and not find(r"\bJOIN\b"):
        out.append(Advice("implicit_cross_join", f"join {m[1]} and {m[2]} with ON", None, 60.0))
    if m := find(r"(\b[\w.]+)\s*=\s*('[^']*'|\d+)(?:\s+OR\s+\1\s*=\s*(?:'[^']*'|\d+))+"):
        values = re.findall(r"=\s*('[^']*'|\d+)", m[0])
        out.append(Advice("or_to_in", "use IN for alternatives of one column", text.replace(m[0], f"{m[1]} IN ({', '.join(values)})"), 30.0, "high"))
    if m := find(r"\b(UPPER|LOWER|TRIM|CAST)\s*\(\s*(\w+)[^)]*\)\s*="):
        out.append(Advice("function_on_column", f"{m[1].upper()}({m[2]}) hides {m[2]} from file statistics; store the computed value or compare {m[2]} itself", None, 50.0))
    if find(r"\bWHERE\b.*\b(?:IN|EXISTS)\s*\(\s*SELECT\b"):
        out.append(Advice("correlated_subquery", "Catalyst turns this into a semi-join; check the plan for a nested loop", None, 40.0, "low"))
    if with_limit(text) != text:
        out.append(Advice("missing_limit", "limit exploratory results", with_limit(text), 20.0, "low"))
    if find(r"\bCOUNT\s*\(\s*DISTINCT\b"):
        out.append(Advice("count_distinct", "approx_count_distinct is enough if an error of some percent is", None, 70.0))
    if m := find(r"\bLIKE\s+'%([^%_']+)"):
        out.append(Advice("leading_wildcard", f"a pattern that starts with % can't use file statistics; contains('{m[1]}') says the same without a pattern", None, 30.0, "low"))
    return out


class Firewall:
    """Statements by fingerprint: denied ones never run, with an allow list only those on it. Errors deny unless fail_open."""

    def __init__(self, deny: set[str] | None = None, allow: set[str] | None = None, fail_open: bool = False):
        self.deny, self.allow, self.fail_open = set(deny or ()), None if allow is None else set(allow), fail_open

    def block(self, text: str) -> str:
        self.deny.add(fp := fingerprint(text))
        return fp

    def permit(self, text: str) -> str:
        self.allow = (self.allow or set()) | {fp := fingerprint(text)}
        return fp

    def check(self, text: str) -> tuple[bool, str]:
        """(may it run, why)."""
        try:
            fp = fingerprint(text)
        except Exception:
            return self.fail_open, "the statement can't be read"
        if fp in self.deny:
            return False, "denied"
        if self.allow is not None and fp not in self.allow:
            return False, "not on the allow list"
        return True, "allowed"
