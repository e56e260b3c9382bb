"""Facts about a query's plan. The only module that touches Spark's JVM planner; needs a classic (not Connect) session."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

JOINS, AGGREGATES, SCANS = {"Join"}, {"Aggregate"}, {"LogicalRelation", "RelationV2", "DataSourceV2Relation", "HiveTableRelation", "LogicalRDD", "UnresolvedRelation", "LocalRelation", "Range"}


@dataclass
class Features:
    joins: int = 0
    aggregates: int = 0
    scans: int = 0
    predicates: int = 0
    subqueries: int = 0
    windows: int = 0
    depth: int = 0
    has_limit: bool = False
    has_sort: bool = False
    has_vector: bool = False

    @property
    def complexity(self) -> int:
        return 2 * self.joins + self.aggregates + self.scans


def nodes(plan_json: str) -> list[dict[str, Any]]:
    return json.loads(plan_json)


def _walk(rows: list[dict], at: int = 0, depth: int = 1) -> Iterator[tuple[dict, int]]:
    """Pre-order list to (node, depth)."""

    def visit(k: int, d: int) -> int:
        out.append((rows[k], d))
        k += 1
        for _ in range(rows[out[-1][0]["_i"]]["num-children"]):
            k = visit(k, d + 1)
        return k

    out: list[tuple[dict, int]] = []
    for i, r in enumerate(rows):
        r["_i"] = i
    visit(at, depth)
    yield from out


def _features(plan) -> Features:
    f = Features()
    for node, depth in _walk(nodes(plan.toJSON())):
        name = node["class"].rsplit(".", 1)[-1]
        f.joins += name in JOINS
        f.aggregates += name in AGGREGATES
        f.scans += name in SCANS
        f.windows += name == "Window"
        f.has_limit |= name in ("GlobalLimit", "LocalLimit", "UnresolvedLimit")
        f.has_sort |= name == "Sort"
        f.depth = max(f.depth, depth)
        if name == "Filter":
            f.predicates += max(1, str(node.get("condition")).count("catalyst.expressions.And") + 1)
        text = str({k: v for k, v in node.items() if k != "_i"})
        f.subqueries += text.count("ScalarSubquery") + text.count("ListQuery") + text.count("expressions.Exists")
        f.has_vector |= "ZipWith" in text
    return f


def of_frame(df: DataFrame, optimized: bool = True) -> Features:
    q = df._jdf.queryExecution()
    return _features(q.optimizedPlan() if optimized else q.analyzed())


def of_sql(spark: SparkSession, text: str) -> Features:
    """Of a statement that is only parsed: its tables needn't exist."""
    return _features(spark._jsparkSession.sessionState().sqlParser().parsePlan(text))


def statistics(df: DataFrame) -> dict[str, int | None]:
    """The optimizer's estimate of a frame: bytes and, with table statistics, rows."""
    s = df._jdf.queryExecution().optimizedPlan().stats()
    rows = s.rowCount()
    return {"bytes": int(s.sizeInBytes().toString()), "rows": int(rows.get().toString()) if rows.isDefined() else None}


def canonical_hash(df: DataFrame) -> int:
    """Equal for plans that compute the same up to names of attributes."""
    return int(df._jdf.queryExecution().optimizedPlan().semanticHash())


def explain(df: DataFrame, mode: str = "extended") -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def classify(f: Features) -> str:
    """point_lookup, dashboard_aggregate, adhoc_exploration, etl_pipeline, ml_feature_extraction or vector_search."""
    if f.has_vector:
        return "vector_search"
    if f.scans == 1 and not f.joins and f.predicates and f.has_limit:
        return "point_lookup"
    if f.scans >= 3 and f.joins >= 2 and not f.aggregates and not f.has_limit:
        return "etl_pipeline"
    if f.aggregates >= 2 and f.scans >= 2 and f.joins:
        return "ml_feature_extraction"
    return "dashboard_aggregate" if f.aggregates and f.joins <= 4 else "adhoc_exploration"


#: Limits of a statement, by name of the measure.
LIMITS = {"tables": 10, "joins": 5, "subqueries": 3, "aggregations": 20, "length": 10_000, "depth": 5}


def guard(spark: SparkSession, text: str, limits: dict[str, int] | None = None) -> list[str]:
    """Which limits a statement breaks; none: it may run. Depth counts nested queries."""
    most, f, flat = LIMITS | (limits or {}), of_sql(spark, text), text.upper()
    open_, depth = [], 0
    for m in re.finditer(r"\(\s*SELECT\b|\(|\)", flat):
        if m[0] == ")":
            open_ = open_[:-1]
        else:
            open_.append(m[0] != "(")
            depth = max(depth, sum(open_))
    seen = {"tables": f.scans, "joins": f.joins, "subqueries": len(re.findall(r"\(\s*SELECT\b", flat)), "aggregations": len(re.findall(r"\b(?:COUNT|SUM|AVG|MIN|MAX|STDDEV\w*|VAR\w*)\s*\(", flat)), "length": len(text), "depth": depth}
    return [f"{k}: {seen[k]} of {most[k]}" for k in most if seen[k] > most[k]]
