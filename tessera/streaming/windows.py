"""Windowed aggregates, dedup and SQL on streams; every function takes batches as well."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _late(df: DataFrame, ts: str, watermark: str | None) -> DataFrame:
    return df.withWatermark(ts, watermark) if watermark and df.isStreaming else df


def tumbling(df: DataFrame, ts: str, width: str, keys: list[str], aggs: list[Column], watermark: str | None = "10 minutes") -> DataFrame:
    out = _late(df, ts, watermark).groupBy(F.window(ts, width).alias("w"), *keys).agg(*aggs)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in out.columns if c != "w"])


def sliding(df: DataFrame, ts: str, width: str, slide: str, keys: list[str], aggs: list[Column], watermark: str | None = "10 minutes") -> DataFrame:
    out = _late(df, ts, watermark).groupBy(F.window(ts, width, slide).alias("w"), *keys).agg(*aggs)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in out.columns if c != "w"])


def session(df: DataFrame, ts: str, gap: str, keys: list[str], aggs: list[Column], watermark: str | None = "10 minutes") -> DataFrame:
    out = _late(df, ts, watermark).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(*aggs)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in out.columns if c != "w"])


def dedup(df: DataFrame, keys: list[str], ts: str, watermark: str = "10 minutes") -> DataFrame:
    """First of each key (within the watermark, on a stream, whose state it bounds)."""
    if df.isStreaming:
        return df.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(keys)
    return df.dropDuplicates(keys)


def stream_sql(spark: SparkSession, source: DataFrame, view: str, sql: str) -> DataFrame:
    """A statement over a stream registered as a view."""
    source.createOrReplaceTempView(view)
    return spark.sql(sql)


def file_stream(spark: SparkSession, path: str, schema, format: str = "parquet", max_files: int = 1000) -> DataFrame:
    return spark.readStream.format(format).schema(schema).option("maxFilesPerTrigger", max_files).load(path)


def run_available(df: DataFrame, checkpoint: str, *, path: str | None = None, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> None:
    """Processes what is there and returns: into a parquet folder (append) or through a foreachBatch function."""
    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    q = w.foreachBatch(each).start() if each else w.format("parquet").option("path", path).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
