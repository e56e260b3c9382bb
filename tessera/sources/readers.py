"""Reading: format detection, files, tables, SQL text, samples, snapshots and remote engines."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: File name endings and their formats.
FORMATS = {
    ".csv": "csv", ".txt": "csv", ".tsv": "tsv", ".tab": "tsv", ".parquet": "parquet", ".pq": "parquet", ".orc": "orc", ".avro": "avro",
    ".json": "json", ".jsonl": "jsonl", ".ndjson": "jsonl", ".xlsx": "excel", ".xls": "excel", ".feather": "feather", ".arrow": "feather",
}
#: Formats whose reader needs a package on Spark's class path.
PACKAGED = {"avro", "delta", "iceberg", "hudi", "kafka"}
_SQL = re.compile(r"\s*(?:SELECT|WITH|SHOW|DESCRIBE|EXPLAIN)\b", re.IGNORECASE)


def detect_format(path: str) -> str:
    """Format by ending, without a query string; a folder without one counts as parquet, a name without a slash as a table."""
    bare = re.split(r"[?#]", path)[0].rstrip("/").lower()
    for end, kind in FORMATS.items():
        if bare.endswith(end):
            return kind
    return "parquet" if "/" in bare else "table"


def is_sql(text: str) -> bool:
    """Whether a source text is a statement rather than a path or a table."""
    return bool(_SQL.match(text))


def read(spark: SparkSession, source: Any, format: str | None = None, *, schema: StructType | str | None = None, options: dict[str, Any] | None = None, sample_rows: int | None = None) -> DataFrame:
    """Anything the engine reads, as a lazy DataFrame.

    source: a DataFrame, a pandas DataFrame, an Arrow table, a list of dicts, {"columns", "rows"}, a statement, a
    table name or a path. sample_rows limits the result.
    """
    out = _read(spark, source, format, schema, dict(options or {}))
    return out.limit(sample_rows) if sample_rows is not None else out


def _read(spark: SparkSession, source: Any, format: str | None, schema: Any, options: dict[str, Any]) -> DataFrame:
    if isinstance(source, DataFrame):
        return source
    if isinstance(source, dict):
        return spark.createDataFrame([tuple(r) for r in source["rows"]], schema or source["columns"])
    if not isinstance(source, str):
        return spark.createDataFrame(source, schema) if schema is not None else spark.createDataFrame(source)
    if format is None and is_sql(source):
        return spark.sql(source)
    kind = format or detect_format(source)
    reader = spark.read.options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    if kind in ("csv", "tsv"):
        base = spark.read.option("header", True).option("sep", "\t" if kind == "tsv" else ",")
        base = base.schema(schema) if schema is not None else base.option("inferSchema", True)
        return base.options(**options).csv(source)
    if kind in ("parquet", "orc"):
        return reader.format(kind).load(source)
    if kind in ("json", "jsonl"):
        return reader.option("multiLine", kind == "json").json(source)
    if kind == "table":
        return reader.table(source)
    if kind in ("excel", "feather"):
        return _small(spark, source, kind, options)
    try:
        return reader.format(kind).load(source)
    except Exception as e:
        if kind in PACKAGED:
            raise RuntimeError(f"the {kind} source needs its package on Spark's class path") from e
        raise


def _small(spark: SparkSession, source: str, kind: str, options: dict[str, Any]) -> DataFrame:
    """Formats Spark has no reader for: a file is read by one task's libraries and has to fit there."""
    if kind == "excel":
        import pandas as pd

        return spark.createDataFrame(pd.read_excel(source, **options))
    import pyarrow.feather

    return spark.createDataFrame(pyarrow.feather.read_table(source))


def view(spark: SparkSession, source: Any, name: str, **kw: Any) -> DataFrame:
    """A file or frame as a temporary view."""
    df = read(spark, source, **kw)
    df.createOrReplaceTempView(name)
    return df


def scan(spark: SparkSession, table: str, columns: list[str] | None = None, predicates: Column | None = None) -> DataFrame:
    """A table's columns and rows; Catalyst pushes both into the scan. Names may have catalog and schema parts."""
    df = read(spark, table)
    df = df.where(predicates) if predicates is not None else df
    return df.select(*columns) if columns else df


def sample_percent(rows: int) -> float | None:
    """Share of a table to sample for statistics: none up to 10 million rows, else 0.1 to 10 percent for some 10,000 rows."""
    return None if rows <= 10_000_000 else min(10.0, max(0.1, 10_000 / rows * 100))


def table_sample(df: DataFrame, rows: int, seed: int = 0) -> DataFrame:
    """The sample that statistics of a table of so many rows are taken from."""
    pct = sample_percent(rows)
    return df if pct is None else df.sample(fraction=pct / 100, seed=seed)


def bernoulli(df: DataFrame, percent: float, seed: int = 0) -> DataFrame:
    """Each row with a probability of `percent`."""
    return df.sample(withReplacement=False, fraction=percent / 100, seed=seed)


def hash_sample(df: DataFrame, percent: float, *keys: str) -> DataFrame:
    """A sample that depends on the keys' values alone: the same rows in every run and engine size."""
    return df.where(F.pmod(F.xxhash64(*keys), F.lit(10_000)) < round(percent * 100))


def remote(spark: SparkSession, url: str, query: str, *, partition_column: str | None = None, bounds: tuple[Any, Any] | None = None, partitions: int = 16, fetch_size: int = 10_000, **options: Any) -> DataFrame:
    """A statement on another engine through JDBC (its driver has to be on the class path), read in parallel by a column if given."""
    reader = spark.read.format("jdbc").options(url=url, fetchsize=fetch_size, **options)
    if partition_column is None:
        return reader.option("query", query).load()
    lo, hi = bounds or (0, 0)
    return reader.options(dbtable=f"({query}) q", partitionColumn=partition_column, lowerBound=lo, upperBound=hi, numPartitions=partitions).load()


def as_of(spark: SparkSession, root: str, timestamp: str) -> DataFrame:
    """Time travel over snapshot folders `root/snapshot=<timestamp>`: the last one that isn't later."""
    snaps = [p for p in list_paths(spark, root) if "/snapshot=" in p]
    seen = [p for p in snaps if p.rsplit("snapshot=", 1)[1] <= timestamp]
    if not seen:
        raise ValueError(f"no snapshot of {root} by {timestamp}")
    return spark.read.parquet(max(seen, key=lambda p: p.rsplit("snapshot=", 1)[1]))


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def list_paths(spark: SparkSession, path: str) -> list[str]:
    """Entries of a folder in any store Hadoop knows."""
    fs, p = _fs(spark, path)
    return sorted(s.getPath().toString() for s in fs.listStatus(p)) if fs.exists(p) else []


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def delete(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.delete(p, True))


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """A small object's bytes."""
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def kafka(spark: SparkSession, servers: str, topics: str, *, starting: str = "latest", most: int = 10_000) -> DataFrame:
    """A Kafka stream (its package has to be on the class path)."""
    return spark.readStream.format("kafka").options(**{"kafka.bootstrap.servers": servers, "subscribe": topics, "startingOffsets": starting, "maxOffsetsPerTrigger": most, "failOnDataLoss": "false"}).load()
