"""Compares a query with its SQL in DuckDB, as multisets of rows with columns by name."""

import math
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import duckdb


def cell(x):
    if isinstance(x, Decimal):
        x = float(x)
    if isinstance(x, bool) or x is None:
        return str(x)
    if isinstance(x, (int, float)):
        return "nan" if math.isnan(x) else f"{float(x):.6g}"
    if isinstance(x, (datetime, date)):
        return x.isoformat()
    return repr(x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(cell(x[i]) for i in order) for x in data)


def from_sql(sf_dir, sql):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = con.execute(sql)
    return rows([d[0] for d in got.description], got.fetchall())


def from_spark(df):
    return rows(df.columns, [tuple(x) for x in df.collect()])
