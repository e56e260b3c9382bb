"""Writing: tables, upserts and deletes without a transactional format, exports and fan-out."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import latest, upsert
from .readers import _fs, exists, list_paths, read_bytes


def write_table(df: DataFrame, name: str, *, format: str = "parquet", mode: str = "overwrite", partition_by: list[str] | None = None, bucket_by: tuple[int, list[str]] | None = None) -> None:
    """A query's result as a table; bucketed, later joins on the bucket columns need no shuffle."""
    w = df.write.format(format).mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if bucket_by:
        w = w.bucketBy(bucket_by[0], *bucket_by[1]).sortBy(*bucket_by[1])
    w.saveAsTable(name)


def swap(df: DataFrame, path: str, format: str = "parquet") -> None:
    """Replaces a folder by a frame that may read from it: written beside it, then renamed.

    Two renames, so readers see the old or the new folder, or for a moment none; a crash between them leaves
    the old one at `<path>.old`.
    """
    spark = df.sparkSession
    new, old = f"{path}.new-{int(time.time() * 1000)}", f"{path}.old"
    df.write.format(format).save(new)
    fs, p = _fs(spark, path)
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs.delete(jvm.Path(old), True)
    if fs.exists(p):
        fs.rename(p, jvm.Path(old))
    fs.rename(jvm.Path(new), p)
    fs.delete(jvm.Path(old), True)


def upsert_path(changes: DataFrame, path: str, keys: list[str]) -> None:
    """Rows of `changes` replace those of the same keys in the folder, or are added."""
    spark = changes.sparkSession
    swap(upsert(spark.read.parquet(path), changes, keys) if exists(spark, path) else changes, path)


def delete_path(gone: DataFrame, path: str, keys: list[str]) -> None:
    """Removes the rows of the folder whose keys are in `gone`."""
    spark = gone.sparkSession
    if exists(spark, path):
        swap(spark.read.parquet(path).join(gone.select(*keys).distinct(), keys, "left_anti"), path)


def apply_changes(changes: DataFrame, path: str, keys: list[str], *, op_col: str = "__op", order: list[str] | None = None, drop: list[str] | None = None) -> None:
    """A batch of change events (c, u, r: write; d: delete), the last of each key counts."""
    last = latest(changes, keys, order) if order else changes
    spark = changes.sparkSession
    columns = [c for c in last.columns if c not in {op_col, *(drop or [])}]
    rows = last.where(F.col(op_col) != "d").select(*columns)
    if not exists(spark, path):
        swap(rows, path)
        return
    base = spark.read.parquet(path).join(last.select(*keys).distinct(), keys, "left_anti")
    swap(base.unionByName(rows, allowMissingColumns=True), path)


class KeyedTable:
    """A table in a folder that batches of change events are merged into, by key and event order.

    Rows are filed in `parts` by a hash of their key; a batch rewrites only the parts it touches. A manifest lists each
    part's folder; a new one is written for each batch and renamed into place, so readers see the state before or
    after a batch, whole. Event order and deletions are kept with the rows, so that an event later than the batch that
    merged a newer one of its key changes nothing. Folders that the last two manifests don't list are deleted.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: list[str], op_col: str = "__op", parts: int = 64):
        self.spark, self.path, self.keys, self.order, self.op, self.parts = spark, path, keys, order, op_col, parts

    def _manifests(self) -> list[str]:
        return sorted(p for p in list_paths(self.spark, self.path) if "/manifest-" in p and p.endswith(".json")) if exists(self.spark, self.path) else []

    def _listed(self, manifest: str) -> dict[str, str]:
        return json.loads(read_bytes(self.spark, manifest))

    def _read(self, folders: list[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/{f}" for f in folders])

    def merge(self, changes: DataFrame) -> None:
        """Events c, u, r write and d deletes; the last of each key by `order` counts. Events without an operation are left out."""
        part = F.pmod(F.xxhash64(*self.keys), F.lit(self.parts)).cast("int")
        fresh = latest(changes.where(F.col(self.op).isNotNull()), self.keys, self.order).withColumn("_part", part)
        made = self._manifests()
        now = self._listed(made[-1]) if made else {}
        touched = [str(r[0]) for r in fresh.select("_part").distinct().collect()]  # at most `parts`
        if not touched:
            return
        old = [now[k] for k in touched if k in now]
        if old:
            base = self._read(old).withColumn("_part", part)
            fresh = latest(base.unionByName(fresh, allowMissingColumns=True), self.keys, self.order)
        batch = f"data-{uuid.uuid4().hex}"
        fresh.repartition("_part").write.partitionBy("_part").parquet(f"{self.path}/{batch}")
        now |= {k: f"{batch}/_part={k}" for k in touched}
        fs, _ = _fs(self.spark, self.path)
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        n = int(made[-1].rsplit("-", 1)[1].removesuffix(".json")) + 1 if made else 0
        new = hadoop.Path(f"{self.path}/manifest-{n:09d}.json.new")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps(now).encode()))
        out.close()
        if not fs.rename(new, hadoop.Path(f"{self.path}/manifest-{n:09d}.json")):
            raise RuntimeError(f"another writer made manifest {n}")
        kept = {f for m in self._manifests()[-2:] for f in self._listed(m).values()}
        for folder in {f for m in made for f in self._listed(m).values()} - kept:
            fs.delete(hadoop.Path(f"{self.path}/{folder}"), True)
        for m in self._manifests()[:-2]:
            fs.delete(hadoop.Path(m), False)

    def read(self) -> DataFrame:
        """The rows that are not deleted, without operation and order columns (but for keys)."""
        made = self._manifests()
        rows = self._read(sorted(self._listed(made[-1]).values()))
        return rows.where(F.col(self.op) != "d").drop(self.op, *[c for c in self.order if c not in self.keys])


def append_jdbc(df: DataFrame, url: str, table: str, **options: Any) -> None:
    df.write.format("jdbc").options(url=url, dbtable=table, **options).mode("append").save()


def export(df: DataFrame, path: str, *, format: str = "parquet", time_col: str | None = None, start: Any = None, end: Any = None, rows_per_file: int = 10_000) -> None:
    """Rows with start <= time < end in order of time, in files of at most rows_per_file rows."""
    if time_col:
        df = df.where((F.col(time_col) >= F.lit(start)) & (F.col(time_col) < F.lit(end))).orderBy(time_col)
    w = df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file)
    (w.option("header", True).csv(path) if format == "csv" else w.format(format).save(path))


def fan_out(send: Callable[[list[dict]], None], batch: int = 100) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that hands each partition's rows, as dicts, to `send` in batches; it runs on the executors."""

    def partition(rows) -> None:
        kept: list[dict] = []
        for r in rows:
            kept.append(r.asDict(recursive=True))
            if len(kept) == batch:
                send(kept)
                kept = []
        if kept:
            send(kept)

    return lambda df, _: df.foreachPartition(partition)


def describe(spark: SparkSession, name: str) -> dict[str, str]:
    """Statistics of a table, after analysing it for all columns."""
    spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR ALL COLUMNS")
    return {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect()}
