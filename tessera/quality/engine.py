"""Evaluation: all rules of a suite but custom SQL are one aggregate over one scan.

custom_sql sees the table as the view `data` and holds if the first cell is true, a number other than 0, or a text
other than '', 'false' and '0'. A rule that can't be evaluated fails with its message.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime, timezone
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, SparkSession

from .rules import Rule, Suite


class Outcome(NamedTuple):
    rule: Rule
    passed: bool
    measured: Any
    error: str | None


class Report(NamedTuple):
    """What a suite found at a time."""

    suite: Suite
    at: datetime
    outcomes: tuple[Outcome, ...]

    def tally(self) -> dict[str, float]:
        """Numbers of rules by outcome, and the share that passed in percent (0 without rules)."""
        bad = [o.rule.blocking for o in self.outcomes if not o.passed]
        n = len(self.outcomes)
        return {"total": n, "passed": n - len(bad), "failed": len(bad), "blocking": sum(bad), "warnings": len(bad) - sum(bad), "score": 100.0 * (n - len(bad)) / n if n else 0.0}

    def frame(self, spark: SparkSession) -> DataFrame:
        """A row per rule: for history tables and dashboards."""
        rows = []
        for r, passed, measured, error in self.outcomes:
            metrics = {} if error else {r.spec.measured: measured} | ({r.spec.parameter: r.limit} if r.spec.parameter else {})
            rows.append((self.suite.name, r.dataset or self.suite.dataset, r.name, r.kind, r.column, "blocking" if r.blocking else "warning", passed, {k: None if v is None else str(v) for k, v in metrics.items()}, error, self.at))
        return spark.createDataFrame(rows, "suite string, dataset string, rule string, kind string, column string, severity string, passed boolean, metrics map<string,string>, error string, evaluated_at timestamp")


class GateClosed(Exception):
    """A blocking rule failed; `report` tells all."""

    def __init__(self, report: Report):
        first = next(o for o in report.outcomes if o.rule.blocking and not o.passed)
        super().__init__(f"{report.suite.name}: {first.rule.name} failed" + (f": {first.error}" if first.error else ""))
        self.report = report


def _message(e: Exception) -> str:
    return str(e).splitlines()[0][:300]


def fused(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row with the measures r0, r1, ... of rules that need the scan."""
    return df.agg(*[r.aggregate().alias(f"r{k}") for k, r in enumerate(rules)])


def _analysed(df: DataFrame, rules: dict[int, Rule]) -> dict[int, str]:
    """Messages of the rules that the analyser refuses: one plan if all are fine, else one for each."""
    out = {k: f"no column {r.column}" for k, r in rules.items() if r.column and r.column not in df.columns}
    rest = {k: r for k, r in rules.items() if k not in out}
    try:
        if rest:
            fused(df, list(rest.values()))
    except Exception:
        for k, r in rest.items():
            try:
                fused(df, [r])
            except Exception as e:
                out[k] = _message(e)
    return out


def evaluate(df: DataFrame, suite: Suite, clock: Callable[[], datetime] | None = None) -> Report:
    """A suite's report in one job, and one more for each custom SQL rule."""
    now = clock() if clock else datetime.now(timezone.utc)
    now = now if now.tzinfo else now.replace(tzinfo=timezone.utc)
    scanned = {k: r for k, r in enumerate(suite.rules) if r.spec.measure is not None}
    errors = _analysed(df, scanned)
    fine = {k: r for k, r in scanned.items() if k not in errors}
    found: dict[int, Any] = {}
    try:
        if fine:
            found = dict(zip(fine, fused(df, list(fine.values())).first(), strict=True))
    except Exception:  # one fails as it runs: find which
        for k, r in fine.items():
            try:
                found[k] = fused(df, [r]).first()[0]
            except Exception as e:
                errors[k] = _message(e)
    for k, r in enumerate(suite.rules):
        if k not in scanned:
            try:
                df.createOrReplaceTempView("data")
                row = df.sparkSession.sql(r.limit).first()
                found[k] = row[0] if row else None
            except Exception as e:
                errors[k] = _message(e)
    outcomes = []
    for k, r in enumerate(suite.rules):
        value = found.get(k)
        if r.kind == "freshness" and value is not None:
            value = (now.timestamp() - value / 1_000_000) / 3600
        passed = False
        if k not in errors:
            try:
                passed = bool(r.spec.holds(value, r.limit))
            except Exception as e:
                errors[k] = _message(e)
        outcomes.append(Outcome(r, passed, value, errors.get(k)))
    return Report(suite, now, tuple(outcomes))


def gate(df: DataFrame, suite: Suite, clock: Callable[[], datetime] | None = None) -> Report:
    """evaluate(), raising GateClosed at a blocking failure."""
    report = evaluate(df, suite, clock)
    if report.tally()["blocking"]:
        raise GateClosed(report)
    return report


def explain(o: Outcome) -> str:
    """An outcome in a sentence."""
    r = o.rule
    what = f"{r.kind} on {r.column}" if r.column else r.kind
    if o.error:
        return f"{r.name}: {what} couldn't be evaluated: {o.error}"
    limit = f", {r.spec.parameter} = {r.limit}" if r.spec.parameter else ""
    return f"{r.name}: {what} {'holds' if o.passed else 'fails'} ({r.spec.measured} = {o.measured}{limit})"
