"""Catalog, jobs, command line, keyed tables."""

import json
import time
from datetime import date, datetime

import pytest

from tessera import catalog, cli, jobs
from tessera.operators import relational as R
from tessera.operators import vector_search as V
from tessera.operators import windows as W
from tessera.session import scratch
from tessera.sources.sinks import KeyedTable


def test_catalog(spark, tmp_path):
    c = catalog.Catalog(spark, str(tmp_path / "catalog.json"))
    urn = "urn:raw"
    assert c.register(urn, columns={"id": "int", "event_type": "string"}, name="raw events")["added"] == []
    assert c.register(urn, columns={"id": "int", "created_at": "timestamp"}, name="raw events") == {"added": ["created_at"], "removed": ["event_type"], "changed": []}
    for a, b in [("a", "b"), ("b", "c"), ("c", "a"), *[(f"n{k}", f"n{k + 1}") for k in range(15)]]:
        c.link(a, b)
    assert {(r.node, r.depth) for r in c.lineage("a", 5).collect()} == {("b", 1), ("c", 2)}
    assert {(r.node, r.depth) for r in c.lineage("a", 1, up=True).collect()} == {("c", 1)}
    assert c.lineage("n0", 99).count() == catalog.FARTHEST
    c.tag(urn, "PII")
    assert {r.tag for r in c.frame("tags").collect()} == {"PII", "encryption_policy_applied"}
    assert c.score(urn) == 0.0
    for ok in (True, True, False, True):
        c.check(urn, "x", ok)
    assert c.score(urn) == 75.0 and c.may("admin", urn, "read") and not c.may("ann", urn, "read")
    c.grant("ann", urn, "read")
    assert c.may("ann", urn, "read") and [r.urn for r in c.search("encryption").collect()] == [urn] and c.search("nothing").count() == 0
    again = catalog.Catalog(spark, str(tmp_path / "catalog.json"))
    assert again.score(urn) == 75.0 and again.get(urn)["columns"] == {"id": "int", "created_at": "timestamp"} and again.delete(urn) and again.get(urn) is None


def test_jobs(spark):
    runner, seen = jobs.Runner(spark, most=1, deep=3), []
    first = runner.submit(lambda s: time.sleep(1) or seen.append("first"))
    while runner.status(first) != jobs.RUNNING:
        time.sleep(0.01)
    late = runner.submit(lambda s: seen.append("late"), priority=9)
    soon = runner.submit(lambda s: seen.append("soon"), priority=1)
    gone = runner.submit(lambda s: seen.append("gone"), priority=5)
    with pytest.raises(jobs.QueueFull):
        runner.submit("SELECT 1")
    assert runner.cancel(gone) and not runner.cancel(gone) and runner.wait(gone, 5) == jobs.CANCELLED
    assert runner.wait(late, 60) == jobs.SUCCEEDED and runner.status(soon) == jobs.SUCCEEDED and seen == ["first", "soon", "late"]
    bad = runner.submit("SELECT no_such_column")
    assert runner.wait(bad, 60) == jobs.FAILED and "no_such_column" in runner.runs[bad].error and len(runner.logs(bad, 2)) == 2
    good = runner.submit("SELECT id FROM range(7)")
    assert runner.wait(good, 60) == jobs.SUCCEEDED and runner.metrics(good)["rows"] == 7 and runner.status("other") == jobs.UNKNOWN


def test_backfill_is_in_order(spark):
    runs, o = [], jobs.Orchestrator(jobs.Runner(spark, most=1))
    o.deploy("daily", lambda s, day: runs.append(day), ("nightly",))
    keys = o.backfill("daily", date(2024, 1, 1), date(2024, 1, 8))
    assert [o.runner.wait(k, 60) for k in keys] == [jobs.SUCCEEDED] * 7 and runs == [date(2024, 1, k) for k in range(1, 8)]
    assert o.list("nightly") == ["daily"] and o.list("x") == [] and o.delete("daily") and not o.delete("daily") and o.healthy()
    assert jobs.day_frame(spark, "2024-01-02", "2024-01-02").count() == 0


def test_models_and_plug_ins(spark):
    assert jobs.run_models(spark, {"m_b": "SELECT id + 1 AS x FROM {m_a}", "m_a": "SELECT id FROM range(3)"}) == ["m_a", "m_b"]
    with pytest.raises(ValueError):
        jobs.run_models(spark, {"m_c": "SELECT * FROM {m_d}", "m_d": "SELECT * FROM {m_c}"})
    assert jobs.plug_in("tessera.jobs:days") is jobs.days and jobs.plug_in("tessera.jobs.days") is jobs.days
    assert set(jobs.calibrate(spark, 1000)) == {"ping", "scan", "filter", "sort", "aggregate", "join"}


def test_command_line(spark, tmp_path, capsys):
    spark.createDataFrame([(1, "a"), (2, None)], "id long, s string").write.parquet(str(tmp_path / "t.parquet"))
    assert cli.main(["sql", "SELECT count(*) AS n FROM cli_t", f"cli_t={tmp_path / 't.parquet'}"], spark) == 0 and json.loads(capsys.readouterr().out) == {"n": 2}
    suite = str(tmp_path / "s.json")
    assert cli.main(["dq", "generate", str(tmp_path / "t.parquet"), "--out", suite], spark) == 0
    assert cli.main(["dq", "run", str(tmp_path / "t.parquet"), suite], spark) == 0
    (tmp_path / "bad.yaml").write_text("suite: {name: x, rules: [{type: not_null, column: s}]}")
    assert cli.main(["dq", "run", str(tmp_path / "t.parquet"), str(tmp_path / "bad.yaml")], spark) == 1
    assert cli.main(["dq", "show", suite], spark) == 0 and cli.main(["backfill", "2024-02-28", "2024-03-01"]) == 0
    assert capsys.readouterr().out.endswith("2024-02-28\n2024-02-29\n")


def test_late_events_change_nothing(spark):
    t = KeyedTable(spark, scratch(spark, "keyed"), ["k"], ["at", "n"], parts=4)
    event = lambda *rows: spark.createDataFrame(rows, "k int, v string, at long, n long, __op string")
    t.merge(event((1, "a", 10, 0, "c"), (2, "b", 10, 0, "c"), (3, "c", 10, 0, "c")))
    t.merge(event((1, "new", 20, 0, "u"), (2, None, 20, 0, "d"), (None, "none", 5, 0, "c"), (4, "no", 9, 0, None)))
    t.merge(event((1, "old", 15, 0, "u"), (2, "revived", 19, 1, "u"), (3, "c2", 10, 1, "u")))
    assert sorted(map(str, t.read().collect())) == sorted(["Row(k=1, v='new')", "Row(k=3, v='c2')", "Row(k=None, v='none')"])


def test_nulls_of_faults_mended(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (4, [0.0])], "id int, v array<double>")
    assert [(r.id, r.distance) for r in V.knn(rows, "v", [1.0, 0.0], 5, "l2", id_col="id").collect()] == [(1, 0.0)]
    times = spark.createDataFrame([(1, datetime(2024, 1, 1)), (2, None)], "id int, at timestamp")
    assert R.hybrid(times, times, "at", datetime(2023, 1, 1)).count() == 2
    log = spark.createDataFrame([("u", datetime(2024, 1, 1, 0, 0, s), x) for s, x in ((0, "a"), (10, "b"), (20, "c"))], "k string, at timestamp, x string")
    assert {(r.first, r.then) for r in W.sequences(log, "k", "at", "x", 60, 0.5, 1).collect()} == {("a", "b"), ("a", "c"), ("b", "c")}
