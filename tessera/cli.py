"""python -m tessera.cli sql|dq|lineage|backfill: statements, data-quality suites, lineage and days from the command line."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence
from datetime import date

from .session import build


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera")
    sub = p.add_subparsers(dest="command", required=True)
    sql = sub.add_parser("sql", help="run a statement; tables as name=path")
    sql.add_argument("text")
    sql.add_argument("tables", nargs="*")
    sql.add_argument("--rows", type=int, default=20)
    dq = sub.add_parser("dq", help="data quality")
    what = dq.add_subparsers(dest="what", required=True)
    for name in ("run", "generate", "anomalies"):
        x = what.add_parser(name)
        x.add_argument("source")
        x.add_argument("suite", nargs="?")
        x.add_argument("--out")
    what.add_parser("show").add_argument("suite")
    lineage = sub.add_parser("lineage", help="what a dataset comes from or goes to")
    lineage.add_argument("edges", help="a file with source and target")
    lineage.add_argument("urn")
    lineage.add_argument("--depth", type=int, default=1)
    lineage.add_argument("--up", action="store_true")
    days = sub.add_parser("backfill", help="the days of [start, end)")
    days.add_argument("start", type=date.fromisoformat)
    days.add_argument("end", type=date.fromisoformat)
    return p


def main(argv: Sequence[str] | None = None, spark=None) -> int:
    """0: done; 1: a blocking rule failed."""
    a = parser().parse_args(argv)
    if a.command == "backfill":
        from .jobs import days

        print("\n".join(map(str, days(a.start, a.end))))
        return 0
    from . import quality
    from .sources.readers import read, view

    if a.command == "dq" and a.what == "show":
        for suite in quality.load(a.suite):
            print(json.dumps(quality.plain(suite), indent=2, default=str))
        return 0
    spark = spark or build("tessera-cli")
    if a.command == "sql":
        for t in a.tables:
            name, _, path = t.partition("=")
            view(spark, path, name)
        for r in spark.sql(a.text).limit(a.rows).collect():
            print(json.dumps(r.asDict(recursive=True), default=str))
        return 0
    if a.command == "lineage":
        from .catalog import walk

        for r in walk(read(spark, a.edges), a.urn, a.depth, a.up).orderBy("depth", "node").collect():
            print(r.depth, r.node)
        return 0
    df = read(spark, a.source)
    if a.what == "generate":
        suite = quality.suggest(df, a.suite or "suggested", a.source)
        if a.out:
            quality.save(suite, a.out)
        print(json.dumps(quality.plain(suite), indent=2, default=str))
        return 0
    if a.what == "anomalies":
        for r in quality.anomalies(df).collect():
            print(r.column, r.kind, r.value)
        return 0
    closed = False
    for suite in quality.load(a.suite):
        report = quality.evaluate(df, suite)
        print(suite.name, json.dumps(report.tally()))
        for o in report.outcomes:
            print(" ", quality.explain(o))
        if a.out:
            quality.save(report, a.out)
        closed = closed or report.tally()["blocking"] > 0
    return int(closed)


if __name__ == "__main__":
    sys.exit(main())
