"""A catalog of datasets: search, lineage, quality, tags and access. All of it is plain tables, kept as frames or files."""

from __future__ import annotations

import json
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import scratch

#: Hops that a lineage walk goes, at most.
FARTHEST = 10
#: Tables of the catalog and their columns.
TABLES = {
    "datasets": "urn string, name string, description string, columns map<string,string>",
    "edges": "source string, target string, job string, at timestamp",
    "tags": "urn string, tag string",
    "checks": "urn string, check string, passed boolean, metrics map<string,double>, at timestamp",
    "grants": "user string, urn string, action string",
}


def walk(edges: DataFrame, start: str, depth: int = 1, up: bool = False) -> DataFrame:
    """(node, depth) of what is reachable from `start` in at most `depth` hops (and FARTHEST), by the shortest way.

    edges: (source, target). Every node is visited once, so cycles end; a hop is one join of the frontier.
    """
    spark = edges.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(scratch(spark, "lineage"))
    a, b = ("target", "source") if up else ("source", "target")
    e = edges.select(F.col(a).alias("node"), F.col(b).alias("next")).where("next is not null").distinct()
    seen = frontier = spark.createDataFrame([(start, 0)], "node string, depth int")
    for hop in range(1, min(depth, FARTHEST) + 1):
        frontier = frontier.join(e, "node").select(F.col("next").alias("node")).distinct().join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(hop))
        frontier = frontier.checkpoint()  # or each hop would hold all earlier ones' plans twice
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.where("depth > 0")


def pipeline_edges(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Each source (urn, columns array) with each target of a pipeline, with their columns zipped; both sides are a pipeline's few datasets."""
    a, b = sources.select(F.col("urn").alias("source"), F.col("columns").alias("from_")), targets.select(F.col("urn").alias("target"), F.col("columns").alias("to_"))
    return a.join(F.broadcast(b), how="cross").select("source", "target", F.arrays_zip("from_", "to_").alias("columns"))


def search(datasets: DataFrame, text: str, tags: DataFrame | None = None) -> DataFrame:
    """Datasets whose name, description or a tag contains a text, in any case."""
    t = text.lower()
    hit = lambda c: F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(t))
    if tags is None:
        return datasets.where(hit("name") | hit("description"))
    tagged = tags.where(hit("tag")).select(F.col("urn").alias("tagged")).distinct()
    return datasets.join(tagged, F.col("urn") == F.col("tagged"), "left").where(hit("name") | hit("description") | F.col("tagged").isNotNull()).drop("tagged")


def quality(checks: DataFrame, key: str = "urn", passed: str = "passed") -> DataFrame:
    """(key, checks, score): passed checks in percent."""
    return checks.groupBy(key).agg(F.count("*").alias("checks"), (F.avg(F.when(F.col(passed), 1.0).otherwise(0.0)) * 100).alias("score"))


def schema_drift(before: dict[str, str], after: dict[str, str]) -> dict[str, list[str]]:
    """Columns added, removed and of another type."""
    return {"added": sorted(after.keys() - before.keys()), "removed": sorted(before.keys() - after.keys()), "changed": sorted(c for c in before.keys() & after.keys() if before[c] != after[c])}


def access(requests: DataFrame, grants: DataFrame, action: str, admin: str = "admin") -> DataFrame:
    """requests (user, urn) with allowed: whether the user may do the action; admin may do all, names without a grant nothing."""
    by = grants.groupBy("user", "urn").agg(F.collect_set("action").alias("granted"))  # few actions
    return requests.join(by, ["user", "urn"], "left").withColumn("allowed", (F.col("user") == admin) | F.coalesce(F.array_contains("granted", action), F.lit(False))).drop("granted")


class Catalog:
    """The catalog as rows in memory, saved as one JSON file; each table is a frame for queries and joins."""

    #: A tag that brings another with it.
    IMPLIED = {"PII": "encryption_policy_applied"}

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path
        self.rows: dict[str, list[dict[str, Any]]] = {t: [] for t in TABLES}
        if path:
            from .sources.readers import exists, read_bytes

            if exists(spark, path):
                self.rows |= json.loads(read_bytes(spark, path))

    def frame(self, table: str) -> DataFrame:
        fields = [f.split(" ")[0] for f in TABLES[table].split(", ")]
        rows = [tuple(datetime.fromisoformat(r[f]) if f == "at" and r.get(f) else r.get(f) for f in fields) for r in self.rows[table]]
        return self.spark.createDataFrame(rows, TABLES[table])

    def _add(self, table: str, **row: Any) -> None:
        self.rows[table].append(row)
        if self.path:
            from .sources.readers import write_bytes

            write_bytes(self.spark, self.path, json.dumps(self.rows, default=str).encode())

    def register(self, urn: str, df: DataFrame | None = None, name: str = "", description: str = "", columns: dict[str, str] | None = None) -> dict[str, list[str]]:
        """Files a dataset under its URN, in place of an earlier one; returns how its columns changed."""
        columns = dict(df.dtypes) if df is not None else dict(columns or {})
        was = self.get(urn)
        self.rows["datasets"] = [r for r in self.rows["datasets"] if r["urn"] != urn]
        self._add("datasets", urn=urn, name=name or urn, description=description, columns=columns)
        return schema_drift(was["columns"], columns) if was else {"added": [], "removed": [], "changed": []}

    def get(self, urn: str) -> dict[str, Any] | None:
        return next((r for r in self.rows["datasets"] if r["urn"] == urn), None)

    def delete(self, urn: str) -> bool:
        n = len(self.rows["datasets"])
        self.rows["datasets"] = [r for r in self.rows["datasets"] if r["urn"] != urn]
        return len(self.rows["datasets"]) < n

    def link(self, source: str, target: str, job: str = "") -> None:
        self._add("edges", source=source, target=target, job=job, at=datetime.now(timezone.utc).isoformat())

    def lineage(self, urn: str, depth: int = 1, up: bool = False) -> DataFrame:
        return walk(self.frame("edges"), urn, depth, up)

    def tag(self, urn: str, tag: str) -> None:
        for t in [tag, *[more for name, more in self.IMPLIED.items() if tag == name]]:
            if {"urn": urn, "tag": t} not in self.rows["tags"]:
                self._add("tags", urn=urn, tag=t)

    def check(self, urn: str, check: str, passed: bool, metrics: dict[str, float] | None = None) -> None:
        self._add("checks", urn=urn, check=check, passed=bool(passed), metrics=metrics or {}, at=datetime.now(timezone.utc).isoformat())

    def record(self, report) -> None:
        """A data-quality report's outcomes as checks of its dataset."""
        for o in report.outcomes:
            self.check(report.suite.dataset, o.rule.name, o.passed)

    def score(self, urn: str) -> float:
        """Passed checks of a dataset in percent; 0 without any."""
        mine = [r["passed"] for r in self.rows["checks"] if r["urn"] == urn]
        return 100.0 * sum(mine) / len(mine) if mine else 0.0

    def grant(self, user: str, urn: str, action: str) -> None:
        self._add("grants", user=user, urn=urn, action=action)

    def may(self, user: str, urn: str, action: str) -> bool:
        return user == "admin" or {"user": user, "urn": urn, "action": action} in self.rows["grants"]

    def search(self, text: str) -> DataFrame:
        return search(self.frame("datasets"), text, self.frame("tags"))
