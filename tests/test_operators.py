"""Goldens and properties of the operators."""

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.functions.predicates import filter_rows
from tessera.functions.vectors import distance, literal
from tessera.operators import governance as G
from tessera.operators import relational as R
from tessera.operators.analytics import psi
from tessera.quality.engine import GateClosed, evaluate, gate
from tessera.quality.rules import Suite, rule
from tessera.quality.suites import of_plain, plain


@pytest.mark.parametrize(("a", "b", "metric", "want"), [([1, 0], [1, 0], "cosine", 0), ([1, 0], [0, 1], "cosine", 1), ([1, 0], [-1, 0], "cosine", 2), ([3, 4], [0, 0], "l2", 5), ([2, 3], [1, 1], "inner_product", -5)])
def test_distances(spark, a, b, metric, want):
    got = spark.range(1).select(distance(literal([float(x) for x in a]), literal([float(x) for x in b]), metric)).first()[0]
    assert math.isclose(got, want, abs_tol=1e-12)


def test_filters(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "B")], "x int, s string")
    ids = lambda *p, **k: sorted(r.x for r in filter_rows(df, p, **k).collect())
    assert ids(("s", "ILIKE", "b")) == [3] and ids(("s", "IS NULL", None)) == [2]
    assert ids(("x", "NOT IN", [1])) == [2, 3] and ids(("x", "IN", [])) == []
    assert ids(("y", "=", 1), unknown="skip") == [1, 2, 3] and ids(("y", "=", 1), unknown="fail") == []
    with pytest.raises(ValueError):
        ids(("y", "=", 1))


def test_upsert_is_idempotent(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    fresh = spark.createDataFrame([(2, "c"), (None, "m"), (4, "d")], "k int, v string")
    once = R.upsert(base, fresh, ["k"])
    assert sorted(map(str, once.collect())) == sorted(map(str, R.upsert(once, fresh, ["k"]).collect()))
    assert {(r.k, r.v) for r in once.collect()} == {(1, "a"), (2, "c"), (None, "m"), (4, "d")}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_is_plain(spark, how):
    big = spark.range(200).select(F.when(F.col("id") < 120, 1).otherwise(F.col("id") % 7).alias("k"), "id")
    small = spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    assert sorted(map(str, R.salted_join(big, small, "k", 4, how).collect())) == sorted(map(str, big.join(small, "k", how).collect()))


def test_psi(spark):
    a = spark.range(1000).select((F.col("id") % 100).cast("double").alias("x"))
    assert psi(a, a, "x") == 0
    assert psi(a, a.select((F.col("x") / 2).alias("x")), "x") > 0.1
    assert psi(a.select(F.lit(1.0).alias("x")), a, "x") == 0


DIRTY = [(1, "a@x", 5.0, datetime(2024, 1, 1)), (1, None, -2.0, datetime(2024, 1, 2)), (3, "zz", None, None)]
Q = rule
CASES = [
    (Q("not_null", "id"), True, True), (Q("not_null", "email"), False, True), (Q("unique", "id"), False, True), (Q("unique", "email"), True, True),
    (Q("min", "amount", 0), False, True), (Q("max", "amount", 5), True, True), (Q("min_length", "email", 3), False, True), (Q("max_length", "email", 3), True, True),
    (Q("regex", "email", "[a-z]@"), False, True), (Q("accepted_values", "email", ["a@x", "zz"]), True, True), (Q("row_count_min", None, 3), True, False), (Q("row_count_max", None, 2), False, True),
    (Q("freshness", "at", 25), True, False), (Q("completeness", "email", 60), True, False), (Q("custom_sql", None, "SELECT count(*) > 2 FROM data", name="c"), True, False), (Q("not_null", "no_such"), False, False),
]


def test_rules_on_dirty_and_empty(spark):
    schema = "id long, email string, amount double, at timestamp_ntz"
    now = lambda: datetime(2024, 1, 2) + timedelta(hours=20)
    suite = Suite("s", "u", tuple(c[0] for c in CASES))
    for rows, at in ((DIRTY, 1), ([], 2)):
        got = evaluate(spark.createDataFrame(rows, schema), suite, now)
        assert [r.passed for r in got.outcomes] == [c[at] for c in CASES]
    with pytest.raises(GateClosed):
        gate(spark.createDataFrame(DIRTY, schema), suite, now)
    assert plain(of_plain(plain(suite))) == plain(suite) and of_plain(plain(suite)) == suite


def test_policies_close_and_escape(spark):
    df = spark.createDataFrame([("o'x", 1), ("b", 2)], "t string, v int")
    p = [G.RowPolicy("d", ("a",), "t = :tenant_id")]
    assert [r.v for r in G.secured(df, "d", p, "a", {"tenant_id": "o'x"}).collect()] == [1]
    assert G.secured(df, "d", p, "other", {}).count() == 0
    with pytest.raises(ValueError):
        G.secured(df, "d", p, "a", {})
    m = G.masked(df, [G.MaskRule("t", "partial", 1, 1)], "a").collect()
    assert [r.t for r in m] == ["o*x", "*"]
