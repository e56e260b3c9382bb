"""Queries over the test tables, one or more per operator, each with DuckDB SQL for the same rows.

Floating aggregates are rounded on both sides, as sums depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.predicates import filter_rows
from .functions.scalars import date_trunc
from .operators import aggregates as A
from .operators import analytics as X
from .operators import governance as G
from .operators import relational as R
from .operators import vector_search as V
from .operators import windows as W
from .quality.engine import evaluate
from .quality.rules import Suite, rule
from .session import scratch
from .sources.sinks import KeyedTable
from .streaming import cdc
from .streaming import windows as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
SPLIT = "1996-01-01"
CLOCK = datetime(2024, 2, 1)


class Tables:
    """The tables of a folder as attributes; each is read with the columns that the plan needs."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(sql: str | None = None, name: str | None = None):
    """Registers a function of Tables."""

    def add(f: Callable[[Tables], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[key] = sql
        return f

    return add


def r(c, n: int = 4):
    return F.round(c, n)


# Projection and filters


@query("SELECT o_orderkey, o_totalprice * 2 AS twice, upper(o_orderpriority) AS priority FROM orders")
def scan_project(t):
    return t.orders.select("o_orderkey", (F.col("o_totalprice") * 2).alias("twice"), F.upper("o_orderpriority").alias("priority"))


def _filter(name: str, table: str, cols: list[str], preds: list, where: str) -> None:
    query(f"SELECT {', '.join(cols)} FROM {table} WHERE {where}", name)(lambda t: filter_rows(getattr(t, table), preds).select(*cols))


_filter("filter_compare", "orders", ["o_orderkey", "o_totalprice"], [("o_totalprice", ">=", 100000.0), ("o_orderstatus", "!=", "P")], "o_totalprice >= 100000 AND o_orderstatus <> 'P'")
_filter("filter_in_not_in", "orders", ["o_orderkey", "o_orderpriority"], [("o_orderpriority", "IN", ["1-URGENT", "2-HIGH"]), ("o_orderstatus", "NOT IN", ["F"])], "o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus NOT IN ('F')")
_filter("filter_like", "customer", ["c_custkey", "c_name"], [("c_name", "LIKE", "Customer#%1")], "c_name LIKE 'Customer#%1'")
_filter("filter_ilike", "customer", ["c_custkey", "c_mktsegment"], [("c_mktsegment", "ILIKE", "%house%")], "c_mktsegment ILIKE '%house%'")
_filter("filter_between", "lineitem", ["l_orderkey", "l_linenumber", "l_quantity"], [("l_quantity", "BETWEEN", (10.0, 20.0))], "l_quantity BETWEEN 10 AND 20")
_filter("filter_null", "documents", ["doc_id"], [("lang", "IS NOT NULL", None), ("text", "IS NOT NULL", None)], "lang IS NOT NULL AND text IS NOT NULL")


# Joins and set operations


@query("SELECT n_name, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY ALL")
def join_multiway(t):
    o = t.orders.where(F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp_ntz"))
    j = o.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("n_name", "o_orderstatus").agg(F.count("*").alias("n"), r(F.sum("o_totalprice"), 2).alias("total"))


_JOINED = {"inner": "JOIN", "left": "LEFT JOIN", "right": "RIGHT JOIN", "full": "FULL JOIN", "left_semi": "SEMI JOIN", "left_anti": "ANTI JOIN"}
for _how, _sql in _JOINED.items():
    _cols = ["doc_id", "n_chars"] + ([] if "_" in _how else ["lab", "quality"])
    _list = "doc_id, n_chars" if "_" in _how else "d.doc_id, n_chars, l.doc_id AS lab, quality"

    @query(f"SELECT {_list} FROM documents d {_sql} (SELECT * FROM labels WHERE quality = 1) l ON d.doc_id = l.doc_id" if "_" not in _how else f"SELECT doc_id, n_chars FROM documents d WHERE {'NOT ' if _how == 'left_anti' else ''}EXISTS (SELECT 1 FROM labels l WHERE quality = 1 AND l.doc_id = d.doc_id)", f"join_{_how.removeprefix('left_')}")
    def _join(t, how=_how, cols=tuple(_cols)):
        return R.join(t.documents.select("doc_id", "n_chars"), t.labels.where("quality = 1").select(F.col("doc_id").alias("lab"), "quality"), F.col("doc_id") == F.col("lab"), how).select(*cols)


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(t):
    return t.region.crossJoin(t.nation).select("r_name", "n_name")


@query("SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_acctbal < b.s_acctbal")
def join_theta(t):
    b = t.supplier.toDF(*[f"b_{c}" for c in t.supplier.columns])
    return t.supplier.join(b, (F.col("s_nationkey") == F.col("b_s_nationkey")) & (F.col("s_acctbal") < F.col("b_s_acctbal"))).select(F.col("s_suppkey").alias("a"), F.col("b_s_suppkey").alias("b"))


@query("SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL")
def join_salted(t):
    return R.salted_join(t.orders.select(F.col("o_custkey").alias("k"), "o_orderkey"), t.customer.select(F.col("c_custkey").alias("k"), "c_mktsegment"), "k", 8).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("SELECT e.event_id, p.event_id AS purchase FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY ALL) p ON e.user_id = p.user_id AND e.ts >= p.ts")
def join_asof(t):
    p = t.events.where("event_type = 'purchase'").groupBy("user_id", F.col("ts").alias("pts")).agg(F.max("event_id").alias("purchase"))
    return R.asof_join(t.events.select("event_id", "user_id", "ts"), p, ["user_id"], "ts", "pts").select("event_id", "purchase")


@query("SELECT e.event_id, d.s FROM events e JOIN (SELECT DISTINCT date_trunc('day', ts) AS s FROM events) d ON e.ts >= d.s AND e.ts < d.s + INTERVAL 2 DAY")
def join_range(t):
    days = t.events.select(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("s")).distinct().withColumn("e", F.col("s") + F.expr("INTERVAL 2 DAY"))
    sec = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    return R.range_join(t.events.select("event_id", sec("ts").alias("t")), days.select("s", sec("s").alias("a"), sec("e").alias("b")), "t", "a", "b", 86400.0).select("event_id", "s")


_HALVES = "early AS (SELECT o_orderkey AS k, o_totalprice AS v, o_orderstatus AS s FROM orders WHERE o_orderkey % 3 <> 0), late AS (SELECT o_orderkey AS k, o_totalprice + 1 AS v, o_orderpriority AS p FROM orders WHERE o_orderkey % 2 = 0)"


def _halves(t):
    o = t.orders
    return (o.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"), F.col("o_orderstatus").alias("s")),
            o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("k"), (F.col("o_totalprice") + 1).alias("v"), F.col("o_orderpriority").alias("p")))


@query(f"WITH {_HALVES} SELECT coalesce(a.k, b.k) AS k, coalesce(a.v, b.v) AS v, s, p FROM early a FULL JOIN late b ON a.k = b.k")
def stitch_join_coalesce(t):
    return R.stitch_join(list(_halves(t)), ["k"], "full")


@query(f"WITH {_HALVES} SELECT * FROM early UNION ALL BY NAME SELECT * FROM late")
def union_all_by_name(t):
    return R.union_by_name(list(_halves(t)))


@query(f"WITH {_HALVES} SELECT k FROM early UNION SELECT k FROM late")
def union_distinct(t):
    a, b = _halves(t)
    return a.select("k").union(b.select("k")).distinct()


@query(f"WITH {_HALVES} SELECT * FROM (SELECT * FROM early a WHERE NOT EXISTS (SELECT 1 FROM late b WHERE b.k = a.k)) UNION ALL BY NAME SELECT * FROM late")
def merge_upsert(t):
    return R.merge(list(_halves(t)), ["k"])


@query(f"SELECT CASE WHEN o_orderdate >= TIMESTAMP '{SPLIT}' AND o_orderkey % 7 <> 0 THEN 'recent' ELSE 'history' END AS source, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL")
def hybrid_time_split(t):
    rows = t.orders.select("o_orderstatus", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate")).alias("at"))  # every seventh without a time
    recent, history = (rows.withColumn("source", F.lit(x)) for x in ("recent", "history"))
    return R.hybrid(recent, history, "at", F.lit(SPLIT).cast("timestamp_ntz")).groupBy("source", "o_orderstatus").agg(F.count("*").alias("n"))


@query(f"WITH {_HALVES} SELECT k FROM early INTERSECT SELECT k FROM late")
def intersect(t):
    a, b = _halves(t)
    return a.select("k").intersect(b.select("k"))


@query("SELECT l_orderkey FROM lineitem EXCEPT ALL SELECT o_orderkey FROM orders")
def except_all(t):
    return t.lineitem.select("l_orderkey").exceptAll(t.orders.select("o_orderkey"))


# Aggregates


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_quantity), 6) AS avg_qty, count(*) AS n, min(l_tax) AS lo, max(l_tax) AS hi FROM lineitem GROUP BY ALL")
def agg_basic(t):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(r(F.sum("l_quantity"), 2).alias("sum_qty"), r(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), r(F.avg("l_quantity"), 6).alias("avg_qty"), F.count("*").alias("n"), F.min("l_tax").alias("lo"), F.max("l_tax").alias("hi"))


@query("SELECT count(*) AS n, min(o_orderdate) AS first, max(o_orderdate) AS last, count(DISTINCT o_custkey) AS customers FROM orders")
def agg_global(t):
    return A.aggregate(t.orders, [], [("count", "*", "n"), ("min", "o_orderdate", "first"), ("max", "o_orderdate", "last"), ("count_distinct", "o_custkey", "customers")])


@query("SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY ALL")
def agg_distinct(t):
    return A.aggregate(t.events, ["event_type"], [("count_distinct", "user_id", "users")])


@query("SELECT event_type, round(stddev_samp(value), 4) AS sd, round(var_samp(value), 4) AS var FROM events GROUP BY ALL")
def agg_stddev_var(t):
    return t.events.groupBy("event_type").agg(r(F.stddev_samp("value")).alias("sd"), r(F.var_samp("value")).alias("var"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 12")
def agg_having(t):
    return A.aggregate(t.orders, ["o_custkey"], [("count", "*", "n")], F.col("n") > 12)


@query("SELECT event_type, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95, round(quantile_cont(value, 0.99), 4) AS p99 FROM events GROUP BY ALL")
def agg_percentile_cont(t):
    return A.percentiles(t.events, ["event_type"], "value").select("event_type", *[r(c).alias(c) for c in ("p50", "p95", "p99")])


@query("SELECT user_id, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 6) AS error_rate FROM events GROUP BY ALL")
def agg_conditional_rate(t):
    return t.events.groupBy("user_id").agg(r(A.rate(F.col("event_type") == "error"), 6).alias("error_rate"))


for _kind in ("rollup", "cube"):

    @query(f"SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY {_kind.upper()} (l_returnflag, l_linestatus)", f"agg_{_kind}")
    def _super(t, kind=_kind):
        return getattr(t.lineitem, kind)("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus))")
def agg_grouping_sets(t):
    return t.lineitem.groupingSets([["l_returnflag"], ["l_linestatus"]], "l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS c FROM lineitem GROUP BY ALL")
def agg_corr(t):
    return t.lineitem.groupBy("l_returnflag").agg(r(A.correlation("l_quantity", "l_extendedprice"), 6).alias("c"))


@query()
def agg_approx_distinct(t):
    return A.aggregate(t.events, ["event_type"], [("approx_distinct", "user_id", "users")])


@query()
def agg_hll_sketch(t):
    return A.hll_merge(A.hll_sketch(t.events, ["event_type"], "user_id"))


@query()
def agg_cms(t):
    return A.count_min(t.events, "event_type", ["view", "purchase", "none"])


# Windows


@query("SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER v AS rk, dense_rank() OVER v AS dr FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), v AS (PARTITION BY o_custkey ORDER BY o_orderstatus)")
def win_ranks(t):
    v = Window.partitionBy("o_custkey").orderBy("o_orderstatus")
    return W.rank_rows(t.orders, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_orderkey", "rn", F.rank().over(v).alias("rk"), F.dense_rank().over(v).alias("dr"))


@query("SELECT event_id, lag(event_id) OVER w AS prev, lead(event_id, 2) OVER w AS next2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def win_lag_lead(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select("event_id", F.lag("event_id").over(w).alias("prev"), F.lead("event_id", 2).over(w).alias("next2"))


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)) RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW), 4) AS hour FROM events")
def win_moving_avg(t):
    return W.moving_average(t.events, ["user_id"], "ts", "value", {"hour": 3600}).select("event_id", r("hour").alias("hour"))


@query("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running FROM orders")
def win_running_sum(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return t.orders.select("o_orderkey", r(F.sum("o_totalprice").over(w), 2).alias("running"))


@query("SELECT event_id, count(*) FILTER (WHERE event_type = 'error') OVER (PARTITION BY user_id) AS errors FROM events")
def win_filter_case(t):
    return t.events.select("event_id", A.filtered_over("count", None, F.col("event_type") == "error", Window.partitionBy("user_id")).alias("errors"))


@query("WITH l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, value DESC) AS rn FROM events), a AS (SELECT user_id, count(value) AS n, avg(value) AS m, stddev_samp(value) AS s, quantile_cont(value, 0.99) AS p FROM l WHERE rn <= 1000 GROUP BY ALL) SELECT user_id, n, round((p - m) / s, 4) AS z, (p - m) / s > 3 AS alert FROM a WHERE n >= 5 AND s >= 1")
def win_zscore(t):
    return W.z_scores(t.events, "user_id", "ts", "value").select("user_id", "n", r("z").alias("z"), "alert")


@query("WITH x AS (SELECT user_id, value AS y, row_number() OVER (PARTITION BY user_id ORDER BY ts, value) AS i, count(*) OVER (PARTITION BY user_id) AS n, epoch_us(ts) / 1000000 AS s FROM events), a AS (SELECT user_id, n, avg(y) FILTER (WHERE i <= n // 2) AS a, avg(y) FILTER (WHERE i > n // 2) AS b, avg(y) AS my, avg(s - 1704067200) AS ms, max(s) - 1704067200 AS last, max_by(y, i) AS ly, covar_pop(y, s - 1704067200) / nullif(var_pop(s - 1704067200), 0) AS slope FROM x GROUP BY ALL) SELECT user_id, n, round(CAST(greatest(0, floor(coalesce(my + slope * (last + 300 - ms), ly))) AS DOUBLE) / 10) AS predicted_tens, CASE WHEN n < 3 THEN 'stable' WHEN b - a > 0.1 * a THEN 'increasing' WHEN b - a < -0.1 * a THEN 'decreasing' ELSE 'stable' END AS trend FROM a")
def win_trend(t):
    return W.trend(t.events, "user_id", "ts", "value").select("user_id", "n", F.round(F.col("predicted") / 10).alias("predicted_tens"), "trend")


@query("WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) <= 1800000000 THEN 0 ELSE 1 END AS new FROM events) SELECT event_id, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS BIGINT) AS session FROM g")
def win_session_gap(t):
    return W.sessions(t.events, "user_id", "ts", 1800).select("event_id", "session")


@query("WITH x AS (SELECT user_id, epoch_us(ts) AS t, event_type AS e FROM events), c AS (SELECT a.e AS first, b.e AS \"then\", count(*) AS n FROM x a JOIN x b ON a.user_id = b.user_id AND a.e <> b.e AND b.t - a.t <= 7200000000 AND (b.t > a.t OR b.t = a.t AND b.e > a.e) GROUP BY ALL), tot AS (SELECT e AS first, count(*) AS total FROM x GROUP BY ALL) SELECT first, \"then\", n, round(n / total, 6) AS probability FROM c JOIN tot USING (first) WHERE n >= 3 AND n / total >= 0.01")
def sequence_pairs(t):
    return W.sequences(t.events, "user_id", "ts", "event_type", 7200, 0.01).select("first", "then", "n", r("probability", 6).alias("probability"))


@query("WITH b AS (SELECT event_type, hour(ts) AS hour, dayofweek(ts) + 1 AS weekday, count(*) AS n, count(DISTINCT yearweek(ts)) AS weeks FROM events GROUP BY ALL), w AS (SELECT event_type, count(DISTINCT yearweek(ts)) AS all_weeks FROM events GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, hour, weekday) AS rn, sum(n) OVER (PARTITION BY event_type) AS total FROM b) SELECT event_type, CAST(hour AS INTEGER) AS hour, CAST(weekday AS INTEGER) AS weekday, n, round(n / total, 6) AS frequency, round(weeks / all_weeks, 6) AS regularity FROM k JOIN w USING (event_type) WHERE rn = 1")
def seasonality(t):
    return W.seasonality(t.events, "event_type", "ts").select("event_type", "hour", "weekday", "n", r("frequency", 6).alias("frequency"), r("regularity", 6).alias("regularity"))


# Sort and limit


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def topk(t):
    return R.top_k(t.orders.select("o_orderkey", "o_totalprice"), 20, F.desc("o_totalprice"), F.col("o_orderkey"))


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 15 OFFSET 30")
def limit_offset(t):
    return R.page(t.orders.select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 15, 30)


@query("SELECT d.doc_id, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY quality ASC NULLS LAST, d.doc_id LIMIT 100")
def sort_nulls(t):
    return R.top_k(t.documents.select("doc_id").join(t.labels, "doc_id", "left").select("doc_id", "quality"), 100, F.asc_nulls_last("quality"), F.col("doc_id"))


# Scalar functions


@query("SELECT date_trunc('month', o_orderdate) AS month, count(*) AS n FROM orders GROUP BY ALL")
def fn_date_trunc(t):
    return t.orders.groupBy(date_trunc("MM", F.col("o_orderdate")).cast("timestamp_ntz").alias("month")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_orderdate + INTERVAL 7 DAY AS due, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m FROM orders")
def fn_date_arith(t):
    return t.orders.select("o_orderkey", (F.col("o_orderdate") + F.expr("INTERVAL 7 DAY")).alias("due"), F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"))


@query("SELECT p_partkey, lower(p_name) AS low, CAST(length(p_type) AS INTEGER) AS len, substr(p_brand, 1, 5) AS pre, p_brand || '/' || p_type AS both, replace(p_name, ' ', '_') AS rep FROM part")
def fn_string(t):
    return t.part.select("p_partkey", F.lower("p_name").alias("low"), F.length("p_type").alias("len"), F.substring("p_brand", 1, 5).alias("pre"), F.concat_ws("/", "p_brand", "p_type").alias("both"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("rep"))


@query("SELECT page_id, regexp_extract(url, '^https?://([^/]+)/', 1) AS host, regexp_matches(url, 'page=[0-9]+') AS paged FROM pages")
def fn_regex(t):
    return t.pages.select("page_id", F.regexp_extract("url", "^https?://([^/]+)/", 1).alias("host"), F.regexp_like("url", F.lit("page=[0-9]+")).alias("paged"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def fn_json(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("SELECT o_custkey, list_sort(list(o_orderkey))[1] AS first, CAST(len(list(o_orderkey)) AS INTEGER) AS n FROM orders GROUP BY ALL")
def fn_array(t):
    a = F.array_sort(F.collect_list("o_orderkey"))
    return t.orders.groupBy("o_custkey").agg(F.get(a, F.lit(0)).alias("first"), F.size(a).alias("n"))


@query("SELECT c_custkey, md5(c_name) AS m, sha256(c_name) AS s FROM customer")
def fn_hash(t):
    return t.customer.select("c_custkey", F.md5("c_name").alias("m"), F.sha2("c_name", 256).alias("s"))


# Vectors

_Q = [round(((i * 37) % 64 - 32) / 100, 2) for i in range(64)]
_QS = f"{_Q}::DOUBLE[]"
for _m, _f in {"cosine": f"1 - list_cosine_similarity(embedding::DOUBLE[], {_QS})", "l2": f"list_distance(embedding::DOUBLE[], {_QS})", "inner_product": f"-list_dot_product(embedding::DOUBLE[], {_QS})"}.items():

    @query(f"SELECT vec_id, round({_f}, 5) AS distance FROM embeddings ORDER BY {_f}, vec_id LIMIT 10", f"vec_{_m}_topk")
    def _knn(t, m=_m):
        return V.knn(t.embeddings, "embedding", _Q, 10, m, id_col="vec_id", columns=["vec_id"]).withColumn("distance", r("distance", 5))


@query(f"SELECT vec_id, round(list_distance(embedding::DOUBLE[], {_QS}), 5) AS distance FROM embeddings WHERE label = 2 ORDER BY list_distance(embedding::DOUBLE[], {_QS}), vec_id LIMIT 10")
def vec_filtered_topk(t):
    return V.knn(t.embeddings, "embedding", _Q, 10, "l2", F.col("label") == 2, "vec_id", ["vec_id"]).withColumn("distance", r("distance", 5))


@query("WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) SELECT label, CAST(i - 1 AS INTEGER) AS pos, round(avg(x), 5) AS m FROM x GROUP BY ALL")
def vec_centroid(t):
    return A.centroid(t.embeddings, "embedding", ["label"]).select("label", F.posexplode("centroid").alias("pos", "m")).withColumn("m", r("m", 5))


@query("WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(x) AS m FROM x GROUP BY ALL), d AS (SELECT vec_id, x.label, sqrt(sum((x - m) * (x - m))) AS d FROM x JOIN c ON x.label = c.label AND x.i = c.i GROUP BY ALL) SELECT label, round(CASE WHEN count(*) < 2 THEN 0 ELSE avg(d) END, 5) AS spread FROM d GROUP BY label")
def vec_spread(t):
    return A.spread(t.embeddings, "embedding", ["label"]).withColumn("spread", r("spread", 5))


# Data quality: each rule's verdict and the score of the suite

_Y = rule
_RULES = [
    (_Y("not_null", "o_custkey"), "count(*) FILTER (WHERE o_custkey IS NULL) = 0"),
    (_Y("unique", "o_orderkey"), "count(*) = count(DISTINCT o_orderkey)"),
    (_Y("unique", "o_custkey"), "count(*) = count(DISTINCT o_custkey)"),
    (_Y("min", "o_totalprice", 0.0), "min(o_totalprice) >= 0"),
    (_Y("max", "o_totalprice", 1000.0), "max(o_totalprice) <= 1000"),
    (_Y("min_length", "o_orderpriority", 5), "count(*) FILTER (WHERE length(o_orderpriority) < 5) = 0"),
    (_Y("max_length", "o_orderpriority", 6), "count(*) FILTER (WHERE length(o_orderpriority) > 6) = 0"),
    (_Y("regex", "o_orderpriority", "[1-5]-[A-Z]"), "count(*) FILTER (WHERE NOT regexp_matches(o_orderpriority, '^[1-5]-[A-Z]')) = 0"),
    (_Y("accepted_values", "o_orderstatus", ["O", "F"]), "count(*) FILTER (WHERE o_orderstatus NOT IN ('O', 'F')) = 0"),
    (_Y("row_count_min", None, 10), "count(*) >= 10"),
    (_Y("row_count_max", None, 10), "count(*) <= 10"),
    (_Y("freshness", "o_orderdate", 24.0), "(epoch(TIMESTAMP '2024-02-01') - epoch(max(o_orderdate))) / 3600 <= 24"),
    (_Y("completeness", "o_orderstatus", 99.0), "count(o_orderstatus) * 100.0 / count(*) >= 99"),
    (_Y("custom_sql", None, "SELECT count(*) FILTER (WHERE o_orderstatus = 'P') < count(*) / 2 FROM data", name="few_p"), "count(*) FILTER (WHERE o_orderstatus = 'P') < count(*) / 2"),
]
_SUITE = Suite("orders", "orders", tuple(x for x, _ in _RULES))


def _checked(t) -> DataFrame:
    return evaluate(t.orders, _SUITE, lambda: CLOCK).frame(t.spark).select("rule", "passed")


_VERDICTS = " UNION ALL ".join(f"SELECT '{rule.name}' AS rule, {sql} AS passed FROM orders" for rule, sql in _RULES)


@query(_VERDICTS)
def dq_suite(t):
    return _checked(t)


@query(f"SELECT round(100.0 * count(*) FILTER (WHERE passed) / count(*), 4) AS score FROM ({_VERDICTS})")
def dq_suite_score(t):
    return _checked(t).agg(r(100.0 * A.rate(F.col("passed"))).alias("score"))


for _rule, _s in _RULES:

    @query(f"SELECT '{_rule.name}' AS rule, {_s} AS passed FROM orders", f"dq_{_rule.name}")
    def _dq(t, rule=_rule):
        return evaluate(t.orders, Suite("one", "orders", (rule,)), lambda: CLOCK).frame(t.spark).select("rule", "passed")


# Profiles, statistics and logs


@query("SELECT 'o_totalprice' AS \"column\", count(*) AS n, count(*) - count(o_totalprice) AS nulls, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS stddev, 0.0 AS null_fraction, round(min(o_totalprice), 4) AS min, round(max(o_totalprice), 4) AS max, true AS ndv_near FROM orders UNION ALL SELECT 'quality', count(*), count(*) - count(quality), round(avg(quality), 4), round(stddev_samp(quality), 4), round(1 - count(quality) / count(*), 6), min(quality), max(quality), true FROM documents LEFT JOIN labels USING (doc_id)")
def col_profile(t):
    exact = {"o_totalprice": t.orders.agg(F.count_distinct("o_totalprice")).first()[0], "quality": t.labels.agg(F.count_distinct("quality")).first()[0]}
    rows = A.profile(t.orders.select("o_totalprice")).unionByName(A.profile(t.documents.select("doc_id").join(t.labels, "doc_id", "left").select("quality")))
    near = F.when(F.col("column") == "quality", F.col("ndv") == exact["quality"]).otherwise(F.abs(F.col("ndv") - exact["o_totalprice"]) <= 0.05 * exact["o_totalprice"])  # a sketch of 1 percent
    return rows.select("column", "n", "nulls", r("mean").alias("mean"), r("stddev").alias("stddev"), r("null_fraction", 6).alias("null_fraction"), r(F.col("min").cast("double")).alias("min"), r(F.col("max").cast("double")).alias("max"), near.alias("ndv_near"))


@query("SELECT event_type AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM events), 6) AS frequency FROM events GROUP BY event_type ORDER BY n DESC, value LIMIT 3")
def stats_mcv(t):
    return A.most_common(t.events, "event_type", 3).withColumn("frequency", r("frequency", 6))


@query("SELECT CAST(i AS INTEGER) AS position, round(quantile_cont(value, i / 10), 4) AS bound FROM events, range(11) x(i) GROUP BY i".replace("quantile_cont(value, i / 10)", "list_extract((SELECT quantile_cont(value, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]) FROM events), i + 1)").replace("FROM events, range", "FROM range").replace(" GROUP BY i", ""))
def stats_histogram(t):
    return A.equi_depth(t.events, "value").withColumn("bound", r("bound"))


@query("SELECT event_type AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM events), 6) AS frequency FROM events GROUP BY event_type HAVING count(*) >= 0.2 * (SELECT count(*) FROM events)")
def skew_detect(t):
    return R.skew(t.events, "event_type", 0.2).withColumn("frequency", r("frequency", 6))


@query("WITH b AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem WHERE l_returnflag = 'A'), x AS (SELECT l_returnflag AS g, CASE WHEN l_quantity = hi THEN 10 ELSE floor((l_quantity - lo) / ((hi - lo) / 10)) + 1 END AS k FROM lineitem, b WHERE l_returnflag IN ('A', 'N')), n AS (SELECT g, k, count(*) AS n FROM x GROUP BY ALL), s AS (SELECT g, k, n / sum(n) OVER (PARTITION BY g) AS s FROM n) SELECT round(sum((c.s - a.s) * ln(c.s / a.s)), 5) AS psi FROM s a JOIN s c ON a.k = c.k WHERE a.g = 'A' AND c.g = 'N'")
def psi_drift(t):
    a, n = (t.lineitem.where(F.col("l_returnflag") == g) for g in "AN")
    return t.spark.createDataFrame([(round(X.psi(a, n, "l_quantity"), 5),)], "psi double")


@query("WITH a AS (SELECT quantile_cont(value, 0.95) AS p FROM events WHERE event_id % 2 = 0), b AS (SELECT quantile_cont(value, 0.95) AS p FROM events WHERE event_id % 2 = 1) SELECT round(a.p, 4) AS reference, round(b.p, 4) AS current, round(b.p / a.p, 4) AS ratio, b.p / a.p > 1.2 AS drift FROM a, b")
def perf_drift(t):
    return X.performance_drift(t.events.where("event_id % 2 = 0"), t.events.where("event_id % 2 = 1"), "value").select(*[r(c).alias(c) for c in ("reference", "current", "ratio")], "drift")


@query("SELECT count(*) AS queries, round(avg(value), 4) AS avg_ms, round(quantile_cont(value, 0.95), 4) AS p95_ms, round(avg(CASE WHEN event_id % 5 > 2 THEN 100.0 ELSE 0 END), 4) AS join_heavy_pct, round(avg(CASE WHEN event_id % 3 > 0 THEN 100.0 ELSE 0 END), 4) AS agg_heavy_pct, round(avg(CASE WHEN event_id % 5 = 0 AND event_id % 3 = 0 THEN 100.0 ELSE 0 END), 4) AS filter_only_pct FROM events")
def workload_profile(t):
    out = X.workload_profile(t.events.select(F.col("value").alias("ms"), (F.col("event_id") % 5).alias("joins"), (F.col("event_id") % 3).alias("aggs")))
    return out.select("queries", *[r(c).alias(c) for c in out.columns[1:]])


@query("SELECT event_type, count(*) AS queries, round(sum(value), 4) AS total_cost, round(avg(value), 4) AS avg_cost FROM events GROUP BY ALL")
def engine_rollup(t):
    return A.cost_rollup(t.events, "event_type", "value").select("event_type", "queries", r("total_cost").alias("total_cost"), r("avg_cost").alias("avg_cost"))


@query("WITH s AS (SELECT c_nationkey AS k, date_trunc('month', o_orderdate) AS month, sum(o_totalprice) AS spent FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL) SELECT n_nationkey AS k, 1e6 AS budget, month, round(spent, 2) AS spent, round(spent / 1e6, 6) AS used FROM nation LEFT JOIN s ON n_nationkey = k")
def budget_monthly(t):
    usage = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("k"), "o_orderdate", "o_totalprice")
    return A.budget_status(usage, t.nation.select(F.col("n_nationkey").alias("k"), F.lit(1e6).alias("budget")), "k", "o_orderdate", "o_totalprice").select("k", "budget", F.col("month").cast("timestamp_ntz").alias("month"), r("spent", 2).alias("spent"), r("used", 6).alias("used"))


@query("WITH c AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS bucket, user_id AS tenant, sum(value + 10.0 * (event_id % 50)) AS cost FROM events GROUP BY ALL), s AS (SELECT bucket, tenant, cost, coalesce(cost / nullif(sum(cost) OVER (PARTITION BY bucket), 0), 0) AS share FROM c) SELECT bucket, tenant, round(cost, 4) AS cost, round(share, 6) AS share, share > 0.4 AS noisy, CASE WHEN share > 0.4 THEN round(greatest(0.0, 0.9 - 0.8 * (share - 0.4) / 0.6), 3) ELSE 1.0 END AS throttle FROM s")
def noisy_share(t):
    out = A.noisy_share(t.events.withColumn("mem", F.col("event_id") % 50), "user_id", "ts", "value", "mem", bucket="1 hour")
    return out.select("bucket", "tenant", r("cost").alias("cost"), r("share", 6).alias("share"), "noisy", r("throttle", 3).alias("throttle"))


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 10")
def hot_keys(t):
    return A.hot_keys(t.events, ["user_id", "event_type"], 10)


@query("SELECT event_type, count(*) AS n, sum(greatest(0, value - 10)) > 0 AS any_regret, round(sum(greatest(0.0, value - 10)), 3) AS cumulative_regret, round(avg(greatest(0.0, value - 10)), 4) AS average_regret, round(greatest(0.01, exp(-0.00001 * sum(greatest(0.0, value - 10)))), 6) AS weight FROM events GROUP BY ALL")
def regret(t):
    out = X.regret_weights(t.events.withColumn("p", F.lit(10.0)), "event_type", ["ts"], "p", "value", rate=0.00001)
    return out.select("event_type", "n", (F.col("cumulative_regret") > 0).alias("any_regret"), r("cumulative_regret", 3).alias("cumulative_regret"), r("average_regret").alias("average_regret"), r("weight", 6).alias("weight"))


# Governance


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING' OR c_nationkey = 3")
def rls_view(t):
    rules = [G.RowPolicy("customer", ("analyst",), "c_mktsegment = :segment"), G.RowPolicy("customer", ("analyst", "viewer"), "c_nationkey = 3"), G.RowPolicy("customer", ("admin",), "true")]
    return G.secured(t.customer, "customer", rules, "analyst", {"segment": "BUILDING"}).select("c_custkey", "c_mktsegment")


@query("SELECT c_custkey, substr(c_name, 1, 2) || repeat('*', length(c_name) - 5) || right(c_name, 3) AS c_name FROM customer")
def mask_partial(t):
    return G.masked(t.customer.select("c_custkey", "c_name"), [G.MaskRule("c_name", "partial", 2, 3)], "analyst")


@query("SELECT c_custkey, sha256(c_name) AS c_name FROM customer")
def mask_hash(t):
    return G.masked(t.customer.select("c_custkey", "c_name"), [G.MaskRule(".*name", "hash")], "analyst")


# Streams: events as a stream of files, each run to its end


def _streamed(t, name: str, mode: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of a streaming query after it has read the whole table; state and results lie in the shared folder."""
    spark = t.spark
    root = scratch(spark, f"stream-{name}")
    source = spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))  # event times need a zone

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{root}/out")

    S.run_available(make(source), f"{root}/state", mode=mode, each=keep)
    out = spark.read.parquet(f"{root}/out")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in out.columns if c.startswith("window_")})


_AGGS = "count(*) AS n, round(sum(value), 4) AS total"


def _aggs():
    return [F.count("*").alias("n"), r(F.sum("value")).alias("total")]


@query(f"SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type, {_AGGS} FROM events GROUP BY ALL")
def stream_tumbling(t):
    return _streamed(t, "tumbling", "complete", lambda s: S.tumbling(s, "ts", "1 hour", ["event_type"], _aggs()))


@query(f"WITH x AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts) - i * INTERVAL 30 MINUTE AS window_start, value, event_type FROM events, range(2) y(i)) SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, event_type, {_AGGS} FROM x GROUP BY ALL")
def stream_sliding(t):
    return _streamed(t, "sliding", "complete", lambda s: S.sliding(s, "ts", "1 hour", "30 minutes", ["event_type"], _aggs()))


@query(f"WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 1800000000 THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT min(ts) AS window_start, max(ts) + INTERVAL 30 MINUTE AS window_end, user_id, {_AGGS} FROM s GROUP BY user_id, k")
def stream_session(t):
    return _streamed(t, "session", "complete", lambda s: S.session(s, "ts", "30 minutes", ["user_id"], _aggs()))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(t):
    return _streamed(t, "dedup", "append", lambda s: S.dedup(s, ["user_id", "event_type"], "ts", "3650 days").select("user_id", "event_type"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1 AND event_type <> 'error'")
def stream_upsert_latest(t):
    spark = t.spark
    root = scratch(spark, "upsert")
    source = spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)
    changes = source.select("user_id", "event_id", "event_type", "ts", F.when(F.col("event_type") == "error", "d").otherwise("u").alias("__op"), (F.col("event_id") % 3).alias("late"))
    table = KeyedTable(spark, f"{root}/out", ["user_id"], ["ts", "event_id"], parts=8)

    def merge(batch: DataFrame, n: int) -> None:  # in three parts, without regard to time: late events are among them
        for k in range(3):
            table.merge(batch.where(F.col("late") == k).select("user_id", "event_type", "ts", F.col("event_id"), "__op", F.col("event_id").alias("last_event")))

    S.run_available(changes, f"{root}/state", each=merge)
    return table.read().select("user_id", F.col("last_event").alias("event_id"), "event_type")


@query("WITH s AS (SELECT user_id AS table_name, CAST(value AS BIGINT) * 20 AS l FROM events), h AS (SELECT table_name, l, CASE WHEN l <= 300 THEN 'healthy' WHEN l <= 600 THEN 'warning' WHEN l <= 1800 THEN 'critical' ELSE 'stalled' END AS health FROM s) SELECT health, count(DISTINCT table_name) AS tables, max(l) AS max_lag FROM h GROUP BY ALL".replace("CAST(value AS BIGINT)", "CAST(floor(value) AS BIGINT)"))
def cdc_health(t):
    return cdc.health_rollup(t.events.select(F.col("user_id").alias("table_name"), (F.floor("value") * 20).alias("lag_seconds")))


from . import surface as _  # noqa: E402, F401  registers more queries
