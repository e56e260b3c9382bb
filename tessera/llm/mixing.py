"""Mixing sources to target weights along a time-varying curriculum.

Each source has a schedule: its sampling weight as a piecewise linear function of training time t in [0, 1].
The integral of the schedule is the source's share of the token budget. Shares above `cap` epochs of a source
stop there and the excess goes to the others by weight. A source's documents stand in a fixed keyed order, so
that each occurrence of a document covers an interval of the source's token demand; inverting the cumulative
demand D(t) = target * int_0^t w / int_0^1 w at the interval's start gives the occurrence's training position.
Sorting by position interleaves the sources as the schedules ask.

Scale: the prefix sums that place documents are taken over (source, bucket of the order hash) groups, so a
source with a third of all rows, or an id that as many share, is spread over `2**(4 * HEX)` groups; only sums per
group are shuffled for the offsets, which are joined on the partitioning that the prefix sums already have. So a
document is shuffled once to be placed, and once more for each time it is taken, by position. Nothing is
collected; tables by source have one row per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stow, n_words, table

#: Hex digits of the order hash that name a bucket.
HEX = 3
Schedule = list[tuple[float, float]]


def integrals(knots: Schedule) -> list[float]:
    """Integral of the piecewise linear schedule from 0 to each knot."""
    out = [0.0]
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        out.append(out[-1] + (t1 - t0) * (w0 + w1) / 2)
    return out


def _check(schedules: list[Schedule]) -> None:
    for s in schedules:
        if len(s) < 2 or s[0][0] != 0 or s[-1][0] != 1 or any(a[0] >= b[0] for a, b in zip(s, s[1:], strict=False)) or any(w < 0 for _, w in s) or integrals(s)[-1] <= 0:
            raise ValueError(f"a schedule needs rising times from 0 to 1 and weights of at least 0, not all 0: {s}")


def targets(sizes: DataFrame, schedules: list[Schedule], ratio: float, cap: float) -> DataFrame:
    """(source, source_size, ...) with target and sched added.

    Schedules are dealt to the sources by code point, null last, repeating. sum(target) is ratio * sum(size)
    unless every source stops at cap times its size. One row per source goes through one task here.
    """
    integral = F.array(*[F.lit(integrals(s)[-1]) for s in schedules])
    by_name, everything = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("reach", "rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before, rest = Window.orderBy("reach", "rank").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("reach", "rank").rowsBetween(0, Window.unboundedFollowing)
    out = sizes.withColumn("rank", F.row_number().over(by_name) - 1).withColumn("sched", (F.col("rank") % len(schedules)).cast("int"))
    out = out.withColumn("weight", integral[F.col("sched")]).withColumn("most", F.lit(float(cap)) * F.col("source_size")).withColumn("reach", F.col("most") / F.col("weight"))
    budget = F.lit(float(ratio)) * F.sum("source_size").over(everything)
    out = out.withColumn("level", (budget - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    # sources by rising reach: those before the first that the common level doesn't fill are full
    out = out.withColumn("common", F.min(F.when(F.col("level") < F.col("reach"), F.struct("reach", "rank", "level"))).over(everything)["level"])
    return out.select(*sizes.columns, F.when(F.col("common").isNull(), F.col("most")).otherwise(F.least("most", F.col("common") * F.col("weight"))).alias("target"), "sched")


def invert(y: Column, sched: Column, schedules: list[Schedule]) -> Column:
    """Time at which the share y (0 to 1) of a schedule's integral is used up."""
    out = F.lit(None).cast("double")
    for k, s in enumerate(schedules):
        cum, at = integrals(s), F.lit(1.0)
        area = y * F.lit(cum[-1])
        for j in reversed(range(len(s) - 1)):
            (t0, w0), (t1, w1) = s[j], s[j + 1]
            left, slope = area - F.lit(cum[j]), (w1 - w0) / (t1 - t0)
            speed = F.lit(float(w0)) + F.sqrt(F.greatest(F.lit(0.0), F.lit(float(w0 * w0)) + F.lit(2.0 * slope) * left))
            inside = F.lit(float(t0)) + F.when(speed > 0, F.lit(2.0) * left / speed).otherwise(F.lit(0.0))
            at = F.when(area < F.lit(cum[j + 1]), inside).otherwise(at)
        out = F.when(sched == k, at).otherwise(out)
    return out


def plan(docs: DataFrame, schedules: list[Schedule], *, ratio: float = 1.5, cap: float = 2.0, boundary: str = "cut", id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", size_col: str | None = None, content_col: str | None = None, seed: str = "mix") -> DataFrame:
    """One row per input row: doc (struct of all input columns), size, source_size, target and takes.

    takes lists the occurrences in the mix as (epoch, words, position); words is the number of leading words
    taken. boundary="cut" takes part of the document at a source's limit and meets the target to the word;
    "whole" takes that document if at least half of it fits. Size is size_col or the text's number of words.

    Null text or size: size 0, never taken. Null source: a source of its own, after all others. Null ids order
    as the empty id. The order is that of a hash of seed, id and content_col or else all columns, so it doesn't depend on partitions:
    rows of one id with different columns stand apart, and rows that are equal in all columns count as separate
    documents whose places are interchangeable. Map columns don't take part in the hash. Empty table: no rows.
    Input columns stay inside `doc`, so their names can't clash with the plan's.
    """
    _check(schedules)
    if boundary not in ("cut", "whole"):
        raise ValueError(f"boundary: {boundary}")
    size = F.greatest(F.lit(0), F.coalesce(F.col(f"`{size_col}`"), F.lit(0))).cast("long") if size_col else n_words(F.col(text_col))
    hashed = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    content = F.coalesce(F.col(f"`{content_col}`").cast("string"), F.lit("")) if content_col else F.xxhash64(*hashed).cast("string")
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("|"), content))
    # a text that stands for the source, null included: windows and joins on it share one partitioning
    name = F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("null"))
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(source_col).alias("source"), name.alias("name"), size.alias("size"), key.alias("key"))
    base = base.withColumn("bucket", F.substring("key", 1, HEX))
    groups = base.groupBy("name", "source", "bucket").agg(F.sum("size").alias("words"))
    to_source = Window.partitionBy("name").orderBy("bucket")
    groups = groups.withColumn("before", F.coalesce(F.sum("words").over(to_source.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    by_source = targets(groups.groupBy("name", "source").agg(F.sum("words").alias("source_size")), schedules, ratio, cap)
    offsets = groups.select("name", "bucket", "before").join(by_source.select("name", "source_size", "target", "sched"), "name")
    in_bucket = Window.partitionBy("name", "bucket").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = base.withColumn("within", F.coalesce(F.sum("size").over(in_bucket), F.lit(0)))
    placed = placed.join(offsets.hint("merge"), ["name", "bucket"]).withColumn("start", F.col("before") + F.col("within"))
    limit = F.round("target").cast("long")

    def take(epoch: Column) -> Column:
        at = epoch * F.col("source_size") + F.col("start")
        left = F.greatest(F.lit(0), limit - at)
        words = F.least("size", left) if boundary == "cut" else F.when(2 * left >= F.col("size"), F.col("size")).otherwise(0)
        return F.struct(epoch.cast("int").alias("epoch"), words.cast("long").alias("words"), invert(at / F.col("target"), F.col("sched"), schedules).alias("position"))

    epochs = F.array(*[F.lit(e) for e in range(max(1, -int(-cap // 1)))])
    takes = F.when((F.col("size") > 0) & (F.col("target") > 0), F.filter(F.transform(epochs, take), lambda x: x["words"] > 0)).otherwise(F.array().cast("array<struct<epoch:int,words:bigint,position:double>>"))
    return placed.select("doc", "size", "source_size", "target", takes.alias("takes"))


def mix(docs: DataFrame, schedules: list[Schedule], **kw) -> DataFrame:
    """The mix itself: a row per occurrence (doc, epoch, words, position), range-sorted by position."""
    out = plan(docs, schedules, **kw).select("doc", F.explode("takes").alias("take")).select("doc", "take.epoch", "take.words", "take.position")
    return out.orderBy("position", "epoch")


#: Integrals 5, 2 and 1: the first falls, the second rises, the third rises late.
CURRICULUM: list[Schedule] = [[(0.0, 7.0), (1.0, 3.0)], [(0.0, 1.0), (1.0, 3.0)], [(0.0, 0.5), (0.5, 0.5), (1.0, 2.5)]]


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    """Every document with its size, its source's size and target, and the words the mix takes of it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("n_words"), F.md5(F.coalesce("text", F.lit(""))).alias("content"))
    docs = Stow(spark).put(docs, "sized")  # three readers follow; texts are counted once
    out = plan(docs, CURRICULUM, ratio=1.5, cap=2.0, size_col="n_words", content_col="content")
    taken = F.aggregate("takes", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    return out.select(F.col("doc.doc_id").alias("doc_id"), "size", "source_size", "target", taken.alias("taken"), F.round(F.try_element_at("takes", F.lit(1))["position"], 6).alias("position")).orderBy(F.col("position").asc_nulls_last(), "doc_id")


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(concat('mix', coalesce(CAST(doc_id AS VARCHAR), ''), '|', md5(coalesce(text, '')))) AS key
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS sched
  FROM sized GROUP BY source),
w AS (
  SELECT *, CASE sched WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         2.0::DOUBLE * source_size AS most, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM src),
r AS (SELECT *, most / weight AS reach FROM w),
l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY reach, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY reach, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
c AS (SELECT arg_min(level, reach) AS common FROM l WHERE level < reach),
t AS (SELECT source, source_size, sched, CASE WHEN common IS NULL THEN most ELSE least(most, common * weight) END AS target FROM l LEFT JOIN c ON true),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.sched, round(t.target)::BIGINT AS lim,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (
  SELECT *, least(size, greatest(0, lim - start)) + least(size, greatest(0, lim - source_size - start)) AS taken,
         start::DOUBLE / nullif(target, 0) AS y FROM p)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN size > 0 THEN taken ELSE 0 END AS BIGINT) AS taken,
       CASE WHEN size > 0 AND taken > 0 THEN round(CASE sched
         WHEN 0 THEN 2.0 * (y * 5.0) / (7.0 + sqrt(49.0 + 2.0 * -4.0 * (y * 5.0)))
         WHEN 1 THEN 2.0 * (y * 2.0) / (1.0 + sqrt(1.0 + 2.0 * 2.0 * (y * 2.0)))
         ELSE CASE WHEN y * 1.0 < 0.25 THEN 2.0 * (y * 1.0) / (0.5 + sqrt(0.25))
                   ELSE 0.5 + 2.0 * (y - 0.25) / (0.5 + sqrt(0.25 + 2.0 * 4.0 * (y - 0.25))) END END, 6) END AS position
FROM k
"""
