"""Session settings the engine is designed for."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

#: Settings that suit any cluster size; sizes and counts stay with the deployment.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.cbo.enabled": "true",
    "spark.sql.cbo.joinReorder.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.showConsoleProgress": "false",
}


def build(app: str = "tessera", master: str | None = None, **conf: str) -> SparkSession:
    """A session with DEFAULTS; `conf` overrides (dots written as double underscores)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def local(cores: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    n = cores or int(os.environ.get("BENCH_CPUS", "8"))
    return build("tessera-local", f"local[{n}]", **{"spark__sql__shuffle__partitions": str(n), "spark__ui__enabled": "false", **conf})


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the folder that driver and executors share: spark.checkpoint.dir. Unset, a folder of our own in local mode, an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tessera-")
    return f"{root}/{name}-{uuid.uuid4().hex}"
