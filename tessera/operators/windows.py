"""Window analytics over logs: ranking, anomalies, trends, sequences and seasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_rows(df: DataFrame, partition: list[str], order: list[Column], alias: str = "rn") -> DataFrame:
    return df.withColumn(alias, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))


def seconds(ts: str) -> Column:
    """A timestamp as whole seconds, with or without a zone."""
    return F.unix_micros(F.col(ts).cast("timestamp")) / 1_000_000


def moving_average(df: DataFrame, partition: list[str], ts: str, value: str, spans: dict[str, int]) -> DataFrame:
    """alias -> seconds: means over the rows of the last so many seconds, the row's own included."""
    out = df.withColumn("_s", seconds(ts).cast("long"))
    for alias, span in spans.items():
        w = Window.partitionBy(*partition).orderBy("_s").rangeBetween(-span, 0)
        out = out.withColumn(alias, F.avg(value).over(w))
    return out.drop("_s")


def z_scores(df: DataFrame, key: str, ts: str, value: str, rows: int = 1000, alert: float = 3.0) -> DataFrame:
    """(p99 - mean) / stddev over each key's last `rows` rows; keys with under 5 rows or a deviation under 1 are left out."""
    w = Window.partitionBy(key).orderBy(F.desc(ts), F.desc(value))
    last = df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= rows)
    out = last.groupBy(key).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("stddev"), F.percentile(value, 0.99).alias("p99"))
    return out.where("n >= 5 and stddev >= 1").withColumn("z", (F.col("p99") - F.col("mean")) / F.col("stddev")).withColumn("alert", F.col("z") > alert)


def trend(df: DataFrame, key: str, ts: str, value: str, ahead_s: int = 300) -> DataFrame:
    """By key: the direction between the means of the first and second half of its rows (10 percent either way), and the
    least-squares value `ahead_s` seconds after the last row, at least 0 and cut to a whole number. Under three rows: stable."""
    w = Window.partitionBy(key)
    o = w.orderBy(ts, value)
    rows = df.select(key, F.col(value).cast("double").alias("y"), seconds(ts).alias("t"), F.row_number().over(o).alias("i"), F.count("*").over(w).alias("n")).withColumn("first", F.col("i") <= F.floor(F.col("n") / 2))
    out = rows.groupBy(key).agg(
        F.count("*").alias("n"), F.avg(F.when(F.col("first"), F.col("y"))).alias("a"), F.avg(F.when(~F.col("first"), F.col("y"))).alias("b"),
        F.min("t").alias("t0"), F.max("t").alias("t1"), F.avg("t").alias("mt"), F.regr_slope("y", "t").alias("slope"), F.avg("y").alias("my"), F.max_by("y", "i").alias("last"),
    )
    way = F.when(F.col("n") < 3, "stable").when(F.col("b") - F.col("a") > 0.1 * F.col("a"), "increasing").when(F.col("b") - F.col("a") < -0.1 * F.col("a"), "decreasing").otherwise("stable")
    ahead = F.when(F.col("slope").isNull(), F.col("last")).otherwise(F.col("my") + F.col("slope") * (F.col("t1") + ahead_s - F.col("mt")))
    return out.select(key, "n", way.alias("trend"), F.greatest(F.lit(0), F.floor(ahead)).cast("long").alias("predicted"))


def ema(df: DataFrame, key: str, order: list[str], value: str, alpha: float = 0.3) -> DataFrame:
    """Exponential mean of each key's values in order: e = alpha * x + (1 - alpha) * e, from the first value on.

    Unrolled, a value weighs alpha * (1 - alpha) ** (number of later ones), the first without alpha; a sum then
    suffices and no group is held as a list.
    """
    w = Window.partitionBy(key)
    rows = df.select(key, F.col(value).cast("double").alias("x"), F.row_number().over(w.orderBy(*order, value)).alias("i"), F.count("*").over(w).alias("n"))
    weight = F.when(F.col("i") == 1, 1.0).otherwise(alpha) * F.pow(F.lit(1 - alpha), F.col("n") - F.col("i"))
    return rows.groupBy(key).agg(F.sum(weight * F.col("x")).alias("ema"))


def sessions(df: DataFrame, key: str, ts: str, gap_s: int) -> DataFrame:
    """Rows with the number of their session: a new one starts after more than gap_s seconds."""
    o = Window.partitionBy(key).orderBy(ts)
    new = F.coalesce((seconds(ts) - F.lag(seconds(ts)).over(o) > gap_s).cast("int"), F.lit(1))
    return df.withColumn("_new", new).withColumn("session", F.sum("_new").over(o.rangeBetween(Window.unboundedPreceding, 0))).drop("_new")


def sequences(df: DataFrame, key: str, ts: str, item: str, within_s: int = 120, least_p: float = 0.7, least_n: int = 3) -> DataFrame:
    """Pairs (first, then): every other item `then` of the same key that comes within so many seconds after `first`.

    n counts pairs of rows; probability is n by first's rows over all keys, so it can pass 1. Rows of one time are in
    order of their items. Equal rows are counted before they are joined, and the join is by time buckets of within_s,
    so a row meets only its own bucket's and the next one's.
    """
    rows = df.where(F.col(item).isNotNull()).groupBy(F.col(key).alias("k"), seconds(ts).alias("t"), F.col(item).alias("item")).agg(F.count("*").alias("m")).withColumn("b", F.floor(F.col("t") / within_s))
    a = rows.select("k", "b", F.col("t").alias("t1"), F.col("item").alias("first"), F.col("m").alias("m1"))
    later = rows.select("k", F.explode(F.array("b", F.col("b") - 1)).alias("b"), F.col("t").alias("t2"), F.col("item").alias("then"), F.col("m").alias("m2"))
    near = (F.col("first") != F.col("then")) & (F.col("t2") - F.col("t1") <= within_s) & ((F.col("t2") > F.col("t1")) | (F.col("t2") == F.col("t1")) & (F.col("then") > F.col("first")))
    pairs = a.join(later, ["k", "b"]).where(near).groupBy("first", "then").agg(F.sum(F.col("m1") * F.col("m2")).alias("n"))
    total = rows.groupBy(F.col("item").alias("first")).agg(F.sum("m").alias("total"))
    return pairs.join(total, "first").withColumn("probability", F.col("n") / F.col("total")).where((F.col("n") >= least_n) & (F.col("probability") >= least_p))


def seasonality(df: DataFrame, key: str, ts: str) -> DataFrame:
    """Each key's busiest (hour, weekday): its share of the key's rows and in how many of the key's ISO weeks it occurs."""
    t = F.col(ts)
    rows = df.select(key, F.hour(t).alias("hour"), F.dayofweek(t).alias("weekday"), F.concat_ws("-", F.extract(F.lit("YEAROFWEEK"), t).cast("string"), F.weekofyear(t).cast("string")).alias("week"))
    buckets = rows.groupBy(key, "hour", "weekday").agg(F.count("*").alias("n"), F.count_distinct("week").alias("weeks"))
    total = rows.groupBy(key).agg(F.count("*").alias("total"), F.count_distinct("week").alias("all_weeks"))
    best = rank_rows(buckets, [key], [F.desc("n"), F.col("hour"), F.col("weekday")]).where("rn = 1").drop("rn")
    return best.join(total, key).select(key, "hour", "weekday", "n", (F.col("n") / F.col("total")).alias("frequency"), (F.col("weeks") / F.col("all_weeks")).alias("regularity"))
