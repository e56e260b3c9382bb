"""Every base query gives the rows of its SQL."""

import pytest
from tests.oracle import from_spark, from_sql

from tessera.queries import QUERIES, SQL

DIR = "/root/testdata/sf0.01"  # at sf0.001 join_theta has no rows


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = from_spark(QUERIES[name](spark, DIR))
    assert got[1]
    if name in SQL:
        assert got == from_sql(DIR, SQL[name])


def test_sketches_are_near(spark):
    exact = {r[0]: r[1] for r in spark.read.parquet(f"{DIR}/events.parquet").groupBy("event_type").agg({"user_id": "count", "event_id": "count"}).collect()}
    est = {r["value"]: r["estimate"] for r in QUERIES["agg_cms"](spark, DIR).collect()}
    assert est["view"] >= exact["view"] and est["none"] >= 0


def test_entry_imports_and_pairs():
    import __spark_entry__ as e

    assert "join_multiway" in e.queries()
    assert set(e.oracle_sql()) <= set(e.queries())
