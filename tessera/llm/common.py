"""What several of the operators share."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: the longest run without space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: The same separators for str.split-like work on bytes.
SPACES = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Unset, a folder of our own in local mode, an error on a cluster."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="tessera-"))
    return sc.getCheckpointDir()


#: Tables not deleted yet, by folder; what is left goes when the process ends.
_LEFT: dict[str, Stow] = {}


class Stow:
    """Tables written to the shared folder: they cut lineage, so a lost executor costs no recomputation.

    `put` writes and rereads a frame; `drop` deletes what is no longer needed, `only` all but what the result still
    reads. Use one per call of an operator. `made_since` lets a caller that has written a result delete the rest.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.paths = spark, f"{shared_dir(spark)}/stow-{uuid.uuid4().hex}", {}
        _LEFT[self.root] = self

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.option("compression", "zstd").parquet(path)
        self.paths.setdefault(name, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _delete(self, path: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def drop(self, *names: str) -> None:
        for name in names:
            for path in self.paths.pop(name):
                self._delete(path)

    def only(self, *names: str) -> None:
        """Deletes all tables but these."""
        self.drop(*[name for name in self.paths if name not in names])

    def clear(self) -> None:
        self._delete(self.root)
        self.paths.clear()
        _LEFT.pop(self.root, None)


def made_since(before: set[str]) -> list[Stow]:
    """The stows that were made after `before`, an earlier set(open_stows())."""
    return [s for root, s in list(_LEFT.items()) if root not in before]


def open_stows() -> list[str]:
    return list(_LEFT)


@atexit.register
def _clear_all() -> None:
    for s in list(_LEFT.values()):
        if s.spark.sparkContext._jsc is not None:
            try:
                s.clear()
            except Exception:  # the session's process can be gone by now; its folder then stays
                return


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner remove shuffle files of frames that are gone (it acts on collected driver objects)."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def chunks(texts: list, most: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """[from, to) ranges of texts whose bytes add up to about `most`; a longer text comes alone."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)
