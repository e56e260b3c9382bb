"""Change streams: parsing, merging by micro-batch, lag and health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from ..sources.sinks import KeyedTable

#: Fields of a change event besides the table's own.
EVENT_FIELDS = [StructField("__op", StringType()), StructField("__source_ts_ms", LongType()), StructField("__source_scn", LongType()), StructField("__deleted", BooleanType())]


def event_schema(table: StructType) -> StructType:
    """The table's fields and the event's."""
    return StructType([*table.fields, *EVENT_FIELDS])


def parse(raw: DataFrame, table: StructType, value_col: str = "value") -> DataFrame:
    """JSON events with the table's columns, op (c, u, r, d; a deleted flag makes d), event time; other input columns (offset, ...) stay.

    Text that isn't JSON gives null fields and is left out by the merge, which needs an op.
    """
    rest = [c for c in raw.columns if c != value_col]
    out = raw.select(*rest, F.from_json(F.col(value_col).cast("string"), event_schema(table)).alias("e")).select(*rest, "e.*")
    op = F.when(F.coalesce(F.col("__deleted"), F.lit(False)), "d").otherwise(F.col("__op"))
    return out.withColumn("__op", op).withColumn("event_time", F.timestamp_millis("__source_ts_ms"))


def merge_stream(events: DataFrame, path: str, keys: list[str], checkpoint: str, *, watermark: str = "5 minutes", every: str | None = "30 seconds", metrics_path: str | None = None) -> StreamingQuery:
    """Keeps a KeyedTable in the folder in step with the events: per micro-batch, the last event of each key counts.

    every=None processes what is there and stops. An event that comes after a newer one of its key changes nothing.
    Read the rows with keyed(spark, path, keys).read().
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            if not batch.isEmpty():
                keyed(batch.sparkSession, path, keys).merge(batch.drop("__deleted", "event_time", *[c for c in ("topic", "partition", "offset", "key", "timestamp", "timestampType") if c in batch.columns and c not in keys]))
                if metrics_path:
                    lag(batch, batch_id).write.mode("append").parquet(metrics_path)
        finally:
            batch.unpersist()

    w = events.withWatermark("event_time", watermark).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def keyed(spark: SparkSession, path: str, keys: list[str]) -> KeyedTable:
    return KeyedTable(spark, path, keys, ["__source_ts_ms", "__source_scn"])


def lag(batch: DataFrame, batch_id: int, now: Column | None = None) -> DataFrame:
    """One row: events, last event time, lag in seconds, last offset where there is one."""
    now = F.current_timestamp() if now is None else now
    offset = F.max("offset") if "offset" in batch.columns else F.lit(None).cast("long")
    return batch.agg(F.lit(batch_id).cast("long").alias("batch_id"), F.count("*").alias("events"), F.max("event_time").alias("last_event"), (F.unix_timestamp(now) - F.unix_timestamp(F.max("event_time"))).alias("lag_seconds"), offset.alias("last_offset"))


def health(lag_seconds: Column) -> Column:
    """healthy up to 300 s, warning to 600, critical to 1,800; later or unknown: stalled."""
    return F.when(lag_seconds <= 300, "healthy").when(lag_seconds <= 600, "warning").when(lag_seconds <= 1800, "critical").otherwise("stalled")


def health_rollup(status: DataFrame, key: str = "table_name") -> DataFrame:
    """Tables by health class, with the worst lag."""
    return status.withColumn("health", health(F.col("lag_seconds"))).groupBy("health").agg(F.count_distinct(key).alias("tables"), F.max("lag_seconds").alias("max_lag"))


class Tables:
    """One merge stream per table: start, restart those that ended, stop."""

    def __init__(self, spark: SparkSession):
        self.spark, self.starts, self.running = spark, {}, {}

    def add(self, name: str, start) -> None:
        """start: a function without arguments that returns a running query."""
        self.starts[name] = start
        self.running[name] = start()

    def restart_ended(self) -> list[str]:
        ended = [n for n, q in self.running.items() if not q.isActive]
        for n in ended:
            self.running[n] = self.starts[n]()
        return ended

    def stop(self) -> None:
        for q in self.running.values():
            q.stop()
