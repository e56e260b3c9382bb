"""Materialised aggregates: kept results that answer queries with the same or a coarser grouping."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Aggregates that can be computed from finer groups, and how.
REGROUP = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}


@dataclass(frozen=True)
class AggregateQuery:
    """SELECT keys, aggregates FROM table [WHERE condition] GROUP BY keys; aggregates: (function, column, alias)."""

    table: str
    keys: tuple[str, ...]
    aggregates: tuple[tuple[str, str, str], ...]
    condition: str | None = None


@dataclass(frozen=True)
class AggregateView:
    name: str
    query: AggregateQuery


class ViewCatalog:
    """Aggregate views and their use. `refresh` writes a view; `answer` reads the smallest one that fits, else the table."""

    def __init__(self, spark: SparkSession):
        self.spark, self.views = spark, {}

    def _run(self, q: AggregateQuery) -> DataFrame:
        from ..operators.aggregates import aggregate

        df = self.spark.table(q.table)
        return aggregate(df.where(q.condition) if q.condition else df, list(q.keys), list(q.aggregates))

    def refresh(self, view: AggregateView) -> None:
        self._run(view.query).write.mode("overwrite").saveAsTable(view.name)
        self.views[view.name] = (view, self.spark.table(view.name).count())

    def match(self, q: AggregateQuery) -> AggregateView | None:
        """A view of the table with the same condition, the query's keys among its own, and every aggregate."""
        fits = []
        for view, rows in self.views.values():
            have = {(f.lower(), c) for f, c, _ in view.query.aggregates}
            same = set(q.keys) == set(view.query.keys)
            if view.query.table == q.table and view.query.condition == q.condition and set(q.keys) <= set(view.query.keys) and all((f.lower(), c) in have and (same or f.lower() in REGROUP) for f, c, _ in q.aggregates):
                fits.append((rows, view.name, view))
        return min(fits)[2] if fits else None

    def answer(self, q: AggregateQuery) -> DataFrame:
        view = self.match(q)
        if view is None:
            return self._run(q)
        names = {(f.lower(), c): a for f, c, a in view.query.aggregates}
        df = self.spark.table(view.name)
        if set(q.keys) == set(view.query.keys):
            return df.select(*q.keys, *[F.col(names[f.lower(), c]).alias(a) for f, c, a in q.aggregates])
        aggs = [REGROUP[f.lower()](names[f.lower(), c]).alias(a) for f, c, a in q.aggregates]
        return df.groupBy(*q.keys).agg(*aggs) if q.keys else df.agg(*aggs)


class ResultCache:
    """Frames kept by normalised statement: recent results for 5 minutes, daily ones for an hour, historical ones for 7 days."""

    TTL = {"recent": 300, "daily": 3600, "historical": 7 * 86_400}

    def __init__(self, spark: SparkSession, most: int = 200, clock=None):
        import time

        self.spark, self.most, self.clock, self.kept, self.hits, self.misses = spark, most, clock or time.time, {}, 0, 0

    def sql(self, text: str, tier: str = "recent") -> DataFrame:
        key = " ".join(text.split())
        now, entry = self.clock(), self.kept.get(key)
        if entry and now - entry[1] < self.TTL[entry[2]]:
            self.hits += 1
            self.kept[key] = (entry[0], entry[1], entry[2], now)
            return entry[0]
        self.misses += 1
        if entry:
            entry[0].unpersist()
        df = self.spark.sql(text).persist()
        self.kept[key] = (df, now, tier, now)
        if len(self.kept) > self.most:  # a tenth of the entries goes, least recently used first
            for k in sorted(self.kept, key=lambda k: self.kept[k][3])[: max(1, self.most // 10)]:
                self.kept.pop(k)[0].unpersist()
        return df

    def clear(self) -> None:
        for df, *_ in self.kept.values():
            df.unpersist()
        self.kept.clear()
