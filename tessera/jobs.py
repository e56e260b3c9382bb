"""Jobs on a session: submission with admission by priority, status, logs, cancelling, metrics, backfill, models, plug-ins, calibration."""

from __future__ import annotations

import heapq
import importlib
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date, datetime, timedelta
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A job's states.
PENDING, RUNNING, SUCCEEDED, FAILED, CANCELLED, UNKNOWN = "pending", "running", "succeeded", "failed", "cancelled", "unknown"
DONE = (SUCCEEDED, FAILED, CANCELLED)
Work = str | Callable[[SparkSession], Any]


@dataclass
class Run:
    key: str
    name: str
    work: Work
    priority: int
    state: str = PENDING
    result: Any = None
    error: str | None = None
    log: list[str] = field(default_factory=list)
    times: dict[str, float] = field(default_factory=dict)
    ended: threading.Event = field(default_factory=threading.Event)

    def note(self, text: str) -> None:
        self.log.append(f"{datetime.now().isoformat(timespec='seconds')} {text}")


class QueueFull(Exception):
    """More runs wait than the queue holds."""


class Runner:
    """Runs statements (text) and functions of the session, at most `most` at once and `deep` waiting, the least priority number first.

    A run has its own Spark job group, so cancelling it stops its tasks. A statement's result is a DataFrame.
    """

    def __init__(self, spark: SparkSession, most: int = 50, deep: int = 500):
        self.spark, self.most, self.deep = spark, most, deep
        self.runs: dict[str, Run] = {}
        self._waiting: list[tuple[int, float, str]] = []
        self._busy, self._lock = 0, threading.Lock()

    def submit(self, work: Work, *, name: str = "job", priority: int = 5) -> str:
        run = Run(f"run-{uuid.uuid4().hex[:12]}", name, work, priority)
        with self._lock:
            if len(self._waiting) >= self.deep:
                raise QueueFull(f"{self.deep} runs wait")
            self.runs[run.key] = run
            run.times["submitted"] = time.time()
            heapq.heappush(self._waiting, (priority, run.times["submitted"], run.key))
        run.note("submitted")
        self._next()
        return run.key

    def _next(self) -> None:
        with self._lock:
            while self._waiting and self._busy < self.most:
                run = self.runs[heapq.heappop(self._waiting)[2]]
                if run.state == PENDING:
                    self._busy += 1
                    run.state = RUNNING
                    threading.Thread(target=self._do, args=(run,), daemon=True).start()

    def _do(self, run: Run) -> None:
        sc = self.spark.sparkContext
        run.times["started"] = time.time()
        run.note("started")
        try:
            sc.setJobGroup(run.key, run.name, interruptOnCancel=True)
            out = self.spark.sql(run.work) if isinstance(run.work, str) else run.work(self.spark)
            if isinstance(out, DataFrame) and isinstance(run.work, str):
                run.times["rows"] = out.count()
            if run.state != CANCELLED:
                run.result, run.state = out, SUCCEEDED
        except Exception as e:
            if run.state != CANCELLED:
                run.error, run.state = str(e).splitlines()[0][:500], FAILED
        finally:
            run.times["ended"] = time.time()
            run.note(f"{run.state}{': ' + run.error if run.error else ''}")
            run.ended.set()
            with self._lock:
                self._busy -= 1
            self._next()

    def status(self, key: str) -> str:
        return self.runs[key].state if key in self.runs else UNKNOWN

    def wait(self, key: str, timeout: float | None = None) -> str:
        """The state after the run has ended, or after `timeout` seconds."""
        if key in self.runs:
            self.runs[key].ended.wait(timeout)
        return self.status(key)

    def logs(self, key: str, tail: int = 100) -> list[str]:
        return self.runs[key].log[-tail:] if key in self.runs else []

    def cancel(self, key: str) -> bool:
        """Whether there was something to cancel."""
        run = self.runs.get(key)
        if run is None or run.state in DONE:
            return False
        waited = run.state == PENDING
        run.state = CANCELLED
        run.note("cancelled")
        if waited:
            run.ended.set()
        else:
            self.spark.sparkContext.cancelJobGroup(key)
        return True

    def metrics(self, key: str) -> dict[str, Any]:
        """Seconds waited and run, Spark jobs, rows of a statement's result."""
        run = self.runs[key]
        t = run.times
        jobs = self.spark.sparkContext.statusTracker().getJobIdsForGroup(key)
        return {"state": run.state, "waited_s": t.get("started", t["submitted"]) - t["submitted"], "ran_s": t.get("ended", time.time()) - t["started"] if "started" in t else 0.0, "spark_jobs": len(jobs), "rows": t.get("rows")}


def days(start: date, end: date) -> list[date]:
    """The days of [start, end)."""
    return [start + timedelta(days=k) for k in range(max(0, (end - start).days))]


def day_frame(spark: SparkSession, start: str, end: str) -> DataFrame:
    """(day): one row for each day of [start, end); no rows if it is empty."""
    span = spark.range(1).select(F.lit(start).cast("date").alias("a"), F.date_sub(F.lit(end).cast("date"), 1).alias("b"))
    return span.where("a <= b").select(F.explode(F.sequence("a", "b")).alias("day"))


class Orchestrator:
    """Jobs by name, run on a Runner; a job is a function of (session, day)."""

    def __init__(self, runner: Runner):
        self.runner = runner
        self.jobs: dict[str, tuple[Callable[[SparkSession, date], Any], frozenset[str]]] = {}

    def deploy(self, name: str, work: Callable[[SparkSession, date], Any], tags: tuple[str, ...] = ()) -> str:
        self.jobs[name] = work, frozenset(tags)
        return name

    def trigger(self, name: str, day: date | None = None, priority: int = 5) -> str:
        work, day = self.jobs[name][0], day or date.today()
        return self.runner.submit(lambda spark: work(spark, day), name=f"{name} {day}", priority=priority)

    def backfill(self, name: str, start: date, end: date) -> list[str]:
        """A run for each day of [start, end), in order."""
        return [self.trigger(name, d, priority=9) for d in days(start, end)]

    def list(self, tag: str | None = None) -> list[str]:
        return sorted(n for n, (_, tags) in self.jobs.items() if tag is None or tag in tags)

    def delete(self, name: str) -> bool:
        return self.jobs.pop(name, None) is not None

    def healthy(self) -> bool:
        return self.runner.spark.range(1).count() == 1


def run_models(spark: SparkSession, models: dict[str, str]) -> list[str]:
    """Statements as views by name, each after those it reads (named as {other} in its text); returns their order."""
    import re

    needs = {n: {m for m in re.findall(r"\{(\w+)\}", text) if m in models} for n, text in models.items()}
    order: list[str] = []
    while len(order) < len(models):
        ready = sorted(n for n in models if n not in order and needs[n] <= set(order))
        if not ready:
            raise ValueError(f"models need each other: {sorted(set(models) - set(order))}")
        order += ready
    for n in order:
        spark.sql(re.sub(r"\{(\w+)\}", r"\1", models[n])).createOrReplaceTempView(n)
    return order


def plug_in(path: str) -> Any:
    """The object of a dotted path `package.module.name`, or `package.module:name`."""
    module, _, name = path.replace(":", ".").rpartition(".")
    return getattr(importlib.import_module(module), name)


def register_functions(spark: SparkSession, functions: dict[str, tuple[Callable, str]]) -> None:
    """Vectorised functions for SQL: name -> (function of pandas series, result type)."""
    from pyspark.sql.functions import pandas_udf

    for name, (f, kind) in functions.items():
        spark.udf.register(name, pandas_udf(f, kind))


def calibrate(spark: SparkSession, rows: int = 200_000) -> dict[str, float]:
    """Milliseconds of small standard plans on this deployment: ping, scan, filter, sort, aggregate, join."""
    df = spark.range(rows).withColumn("g", F.col("id") % 100).withColumn("x", F.rand(1))
    plans = {"ping": spark.range(1), "scan": df, "filter": df.where("x > 0.5"), "sort": df.orderBy("x"), "aggregate": df.groupBy("g").agg(F.sum("x")), "join": df.join(spark.range(100).withColumnRenamed("id", "g"), "g")}
    out = {}
    for name, plan in plans.items():
        began = time.perf_counter()
        plan.write.format("noop").mode("overwrite").save()
        out[name] = (time.perf_counter() - began) * 1000
    return out


def fit_cost(log: DataFrame, features: list[str], ms: str):
    """A linear model of run time from plan features, fitted on a query log; returns a function that adds predicted_ms to a frame."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    rows = VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="skip")
    model = LinearRegression(featuresCol="_features", labelCol=ms, predictionCol="predicted_ms", regParam=1e-6).fit(rows.transform(log))
    return lambda df: model.transform(rows.transform(df)).drop("_features")


def federation(candidates: DataFrame) -> DataFrame:
    """The cheapest way to run a query over several sources: by query, the strategy with the least scan + transfer cost, ties by name."""
    cost = F.col("scan_cost") + F.col("transfer_cost")
    return candidates.withColumn("cost", cost).groupBy("query").agg(F.min(F.struct("cost", "strategy")).alias("m")).select("query", F.col("m.strategy").alias("strategy"), F.col("m.cost").alias("cost"))
