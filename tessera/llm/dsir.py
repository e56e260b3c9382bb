"""Quality by importance resampling: the ratio of hashed n-gram models of target and raw text, sampled by Gumbel top-k.

Word unigrams and bigrams are hashed into BUCKETS. Two add-one smoothed multinomials are fitted: the raw model on
all texts, the target model on the texts labelled good (at most TARGETS of them, by smallest hash of their id).
A document's log importance weight is the sum of log p_target / p_raw over its grams, as in the published method;
the mean, which takes the length out, is an option. Adding Gumbel noise and keeping the k largest keys samples k documents
without replacement in proportion to their weights.

Scale: fitting sends BUCKETS counts per task, scoring shuffles no text, and the k-th largest key is found by
counting keys in ever finer bins, so nothing is sorted as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stow, table
from .words import U, Words, batches, windows

BUCKETS = 10_000
#: Bound of the labelled sample that the target model is fitted on.
TARGETS = 20_000
FRACTION = 0.5


def gram_ids(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of unigrams and of bigrams, and the text of each."""
    h = w.hashes[0]
    doc = np.repeat(np.arange(len(w.count)), w.count)
    pair = doc[:-1] == doc[1:]
    return (h % U(BUCKETS)).astype(np.int64), doc, (windows(h, 2)[pair] % U(BUCKETS)).astype(np.int64), doc[:-1][pair]


def fit(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """log p_target - log p_raw by bucket; BUCKETS rows reach the driver. target_ids are broadcast if they are at most TARGETS, else joined by sort and merge."""
    flags = target_ids.select(F.col(id_col).alias("_id")).where("_id is not null").distinct().withColumn("_good", F.lit(True))
    flags = F.broadcast(flags) if flags.limit(TARGETS + 1).count() <= TARGETS else flags.hint("merge")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(flags, "_id", "left").select("text", F.coalesce("_good", F.lit(False)).alias("good"))

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        out = np.zeros((2, BUCKETS), np.int64)
        for batch in it:
            good = np.array(batch["good"].to_pylist(), bool)
            for i, j, w in batches(batch["text"].to_pylist()):
                one, d1, two, d2 = gram_ids(w)
                out[0] += np.bincount(one, minlength=BUCKETS) + np.bincount(two, minlength=BUCKETS)
                g = good[i:j]
                if g.any():
                    out[1] += np.bincount(one[g[d1]], minlength=BUCKETS) + np.bincount(two[g[d2]], minlength=BUCKETS)
        at = np.flatnonzero(out[0])
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at.astype(np.int32)), "raw": pa.array(out[0][at]), "target": pa.array(out[1][at])})

    got = rows.mapInArrow(count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    counts = np.zeros((2, BUCKETS))
    counts[0, got.bucket], counts[1, got.bucket] = got.raw, got.target
    p = np.log((counts + 1) / (counts.sum(1, keepdims=True) + BUCKETS))
    return p[1] - p[0] if counts[1].any() else np.zeros(BUCKETS)


def score(docs: DataFrame, ratio: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, log_weight, n_grams): the sum of the ratios over the grams of whole texts; 0 without words."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            total, n = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for i, j, w in batches(batch.column(1).to_pylist()):
                one, d1, two, d2 = gram_ids(w)
                total[i:j] = np.bincount(d1, ratio[one], j - i) + np.bincount(d2, ratio[two], j - i)
                n[i:j] = np.bincount(d1, minlength=j - i) + np.bincount(d2, minlength=j - i)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total), pa.array(n)], names=[id_col, "log_weight", "n_grams"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, log_weight double, n_grams long")


def kth_largest(df: DataFrame, col: str, k: int) -> float | None:
    """The exact k-th largest value of a double column; None if there are fewer. Bins are counted, a bin's values are fetched once they are 1,000 at most."""
    lo, hi, n = df.agg(F.min(col), F.max(col), F.count(col)).first()
    if not 0 < k <= n:
        return None
    cond = F.lit(True)
    while lo < hi:
        step = (hi - lo) / 1024
        if step == 0 or lo + step == lo:
            break
        at = F.least(F.floor((F.col(col) - F.lit(lo)) / F.lit(step)), F.lit(1023))
        got = sorted(((r.b, r.n, r.lo, r.hi) for r in df.where(cond).groupBy(at.alias("b")).agg(F.count(col).alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi")).collect()), reverse=True)
        for _, n, a, b in got:
            if k <= n:
                break
            k -= n
        lo, hi, cond = a, b, (F.col(col) >= a) & (F.col(col) <= b)
        if n <= 1000:
            return sorted((r[0] for r in df.where(cond).select(col).collect()), reverse=True)[k - 1]
    return lo if lo == hi else df.where(cond).orderBy(F.desc(col)).limit(k).agg(F.min(col)).first()[0]


def resample(docs: DataFrame, target_ids: DataFrame, fraction: float = FRACTION, *, per_gram: bool = False, scale: float = 100.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, log_weight, key, selected) per row of docs; round(fraction * rows) rows are selected.

    log_weight is the sum over grams, the log ratio of the two models' probabilities of the text, or with per_gram the
    mean times `scale`, which takes the length out (a text of `scale` grams weighs the same either way). The noise depends on seed and id alone, so reruns agree; rows whose keys tie at the limit
    are all selected. Null or empty text: weight 0. Null id: noise of its own, no target. Empty table: no rows.
    """
    stow = Stow(docs.sparkSession)
    ratio = fit(docs, target_ids, id_col, text_col)
    w = F.col("log_weight") / F.greatest("n_grams", F.lit(1)) * scale if per_gram else F.col("log_weight")
    unit = (F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    keyed = score(docs, ratio, id_col, text_col).withColumn("log_weight", w).withColumn("key", F.col("log_weight") - F.log(-F.log(unit)))
    keyed = stow.put(keyed.select(id_col, "log_weight", "key"), "keys")
    k = round(fraction * keyed.count())
    least = kth_largest(keyed, "key", k)
    return keyed.withColumn("selected", F.lit(False) if least is None else F.col("key") >= F.lit(least))


def good_ids(labels: DataFrame, most: int = TARGETS) -> DataFrame:
    """Ids labelled good and not toxic, at most `most`, by smallest hash."""
    return labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def op5_importance_resampling(spark, sf_dir: str) -> DataFrame:
    """Every document with its log importance weight, Gumbel key and whether the sample of half the rows takes it."""
    return resample(table(spark, sf_dir, "documents"), good_ids(table(spark, sf_dir, "labels")))
