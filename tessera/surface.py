"""More queries: statements through the SQL entry, functions, and the operators over catalogs, logs, plans and files."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import catalog, jobs
from .functions import scalars
from .operators import aggregates as A
from .operators import analytics as X
from .operators import governance as G
from .operators import relational as R
from .operators import vector_search as V
from .operators import windows as W
from .plans import estimates, planinfo, questions, sqltext, views
from .quality import Suite, anomalies, evaluate, rule, suggest
from .queries import CLOCK, query, r
from .session import scratch
from .sources import readers, sinks


def both(name: str, text: str, duck: str | None = None) -> None:
    """One statement for spark.sql and DuckDB; {table} stands for a table."""
    plain = re.sub(r"\{(\w+)\}", r"\1", duck or text)
    query(plain, name)(lambda t: t.spark.sql(text, **{n: getattr(t, n) for n in set(re.findall(r"\{(\w+)\}", text))}))


# Statements

both("sql_cte", "WITH c AS (SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey), top AS (SELECT max(n) AS m FROM c) SELECT c.o_custkey, c.n FROM c, top WHERE c.n = top.m")
both("sql_from_subquery", "SELECT s.status, max(s.n) AS n FROM (SELECT o_orderstatus AS status, o_custkey, count(*) AS n FROM {orders} GROUP BY 1, 2) s GROUP BY s.status")
both("sql_lateral", "SELECT c.c_custkey, x.n, x.top FROM {customer} c, LATERAL (SELECT count(*) AS n, max(o.o_orderkey) AS top FROM {orders} o WHERE o.o_custkey = c.c_custkey) x")
both("sql_exists", "SELECT c_custkey FROM {customer} c WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > c.c_acctbal * 30)")
both("sql_not_exists", "SELECT c_custkey FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 250000)")
both("sql_in_subquery", "SELECT p_partkey FROM {part} p WHERE p_partkey IN (SELECT l_partkey FROM {lineitem} l WHERE l.l_partkey = p.p_partkey AND l.l_quantity > p.p_size)")
both("sql_scalar_subquery", "SELECT o_orderkey FROM {orders} o WHERE o_totalprice > (SELECT 1.5 * avg(i.o_totalprice) FROM {orders} i WHERE i.o_custkey = o.o_custkey)")
both("sql_star", "SELECT * FROM {nation}")
both("sql_star_of_one", "SELECT n.*, r.r_name FROM {nation} n JOIN {region} r ON n.n_regionkey = r.r_regionkey")
both("sql_is_null", "SELECT d.doc_id FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id WHERE l.quality IS NULL")
both("sql_recursive", "WITH RECURSIVE x(k, d) AS (SELECT 1, 0 UNION ALL SELECT k * 2, d + 1 FROM x WHERE d < 10) SELECT k, d FROM x")

# Functions

both("fn_log_exp", "SELECT p_partkey, round(log1p(p_retailprice), 6) AS l, round(expm1(p_size / 100.0D), 6) AS e, round(p_retailprice, 1) AS r FROM {part}", "SELECT p_partkey, round(ln(1 + p_retailprice), 6) AS l, round(exp(p_size / 100.0) - 1, 6) AS e, round(p_retailprice, 1) AS r FROM part")
both("fn_sequence", "SELECT n_nationkey, explode(sequence(n_regionkey, n_nationkey, 3)) AS k FROM {nation} WHERE n_nationkey >= n_regionkey", "SELECT n_nationkey, CAST(unnest(generate_series(n_regionkey, n_nationkey, 3)) AS INTEGER) AS k FROM nation WHERE n_nationkey >= n_regionkey")
both("fn_array_contains", "SELECT doc_id, array_contains(split(text, ' '), 'the') AS has FROM {documents}", "SELECT doc_id, list_contains(string_split(text, ' '), 'the') AS has FROM documents")
both("fn_explode", "SELECT w, count(*) AS n FROM (SELECT explode(split(text, ' ')) AS w FROM {documents}) GROUP BY w HAVING count(*) > 50", "SELECT w, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents) GROUP BY w HAVING count(*) > 50")
both("fn_listagg", "SELECT n_regionkey, listagg(n_name, '|') WITHIN GROUP (ORDER BY n_name) AS names FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
both("fn_trim_cast", "SELECT c_custkey, trim(concat('  ', c_name, ' ')) AS name, CAST(c_acctbal AS DECIMAL(12,2)) AS d, CAST(c_custkey AS STRING) AS s FROM {customer}", "SELECT c_custkey, trim(concat('  ', c_name, ' ')) AS name, CAST(c_acctbal AS DECIMAL(12,2)) AS d, CAST(c_custkey AS VARCHAR) AS s FROM customer")
both("fn_json_build", "SELECT event_id, to_json(named_struct('u', user_id, 't', event_type)) AS j FROM {events}", "SELECT event_id, CAST(json_object('u', user_id, 't', event_type) AS VARCHAR) AS j FROM events")
both("fn_json_exists", "SELECT event_id, array_contains(json_object_keys(props), 'no_such_key') AS has, json_object_keys(props)[0] AS k FROM {events}", "SELECT event_id, json_exists(props, '$.no_such_key') AS has, json_keys(props)[1] AS k FROM events")
both("fn_map", "SELECT n_nationkey, element_at(map(n_regionkey, n_name), 2) AS v FROM {nation}", "SELECT n_nationkey, CASE WHEN n_regionkey = 2 THEN n_name END AS v FROM nation")
both("win_ntile", "SELECT o_orderkey, ntile(7) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS n, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS f, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM {orders}")


def _text(name: str, given: str, change, duck: str) -> None:
    """A statement of another dialect, translated and run; beside it the same in DuckDB's words."""
    query(re.sub(r"\{(\w+)\}", r"\1", duck), name)(lambda t: t.spark.sql(change(given), **{n: getattr(t, n) for n in set(re.findall(r"\{(\w+)\}", given))}))


_text("dialect_dates", "SELECT o_orderkey, DATEADD(day, 3, o_orderdate) AS later FROM {orders} ORDER BY o_orderkey FETCH FIRST 20 ROWS ONLY", sqltext.to_spark, "SELECT o_orderkey, o_orderdate + INTERVAL 3 DAY AS later FROM orders ORDER BY o_orderkey LIMIT 20")
_text("dialect_trunc", "SELECT o_orderkey, CAST(TRUNC(o_orderdate, 'MM') AS DATE) AS m FROM {orders}", sqltext.to_spark, "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS m FROM orders")
_text("dialect_filter_over", "SELECT o_orderkey, count(*) FILTER (WHERE o_totalprice > 100000) OVER (PARTITION BY o_custkey) AS n FROM {orders}", sqltext.filter_in_window, "SELECT o_orderkey, count(*) FILTER (WHERE o_totalprice > 100000) OVER (PARTITION BY o_custkey) AS n FROM orders")
_text("auto_limit", "SELECT o_orderkey FROM {orders} ORDER BY o_orderkey", lambda s: sqltext.with_limit(s, 50), "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 50")


@query("SELECT event_id, regexp_replace(regexp_replace(upper('SELECT ' || event_id || ' FROM t'), '[0-9]+', '?', 'g'), '\\s+', ' ', 'g') AS text FROM events")
def fn_normalise(t):
    return t.events.select("event_id", scalars.normalise_sql_col(F.concat(F.lit("SELECT "), F.col("event_id").cast("string"), F.lit("  from t"))).alias("text"))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '1996-03-15' - INTERVAL 30 DAY AND o_orderdate < DATE '1996-03-16'")
def fn_relative_dates(t):
    lo, hi = scalars.relative_range("last 30 days", F.lit("1996-03-15").cast("date"))
    return t.orders.where((F.col("o_orderdate") >= lo) & (F.col("o_orderdate") < hi)).select("o_orderkey")


@query("SELECT c_custkey, c_custkey * 2.0 + 1 AS y FROM customer")
def udf_pandas(t):
    jobs.register_functions(t.spark, {"twice_and_one": (_twice_and_one, "double")})
    return t.spark.sql("SELECT c_custkey, twice_and_one(c_custkey) AS y FROM {c}", c=t.customer)


def _twice_and_one(x: pd.Series) -> pd.Series:
    return x * 2.0 + 1


# Joins, sets, windows, aggregates


@query("SELECT p_partkey, p_size, p_retailprice FROM part p WHERE NOT EXISTS (SELECT 1 FROM part o WHERE o.p_size <= p.p_size AND o.p_retailprice <= p.p_retailprice AND (o.p_size < p.p_size OR o.p_retailprice < p.p_retailprice))")
def pareto_front(t):
    return R.pareto(t.part.select("p_partkey", "p_size", "p_retailprice"), "p_size", "p_retailprice")


@query("SELECT event_type, round(list_reduce(list(value ORDER BY ts, event_id, value), lambda e, x: 0.3 * x + 0.7 * e), 4) AS ema FROM events GROUP BY event_type")
def win_ema(t):
    return W.ema(t.events, "event_type", ["ts", "event_id"], "value").select("event_type", r("ema").alias("ema"))


@query("SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE 'old' END AS v FROM orders ORDER BY o_orderkey DESC")
def merge_sorted(t):
    old = t.orders.select("o_orderkey", "o_totalprice", F.lit("old").alias("v"))
    return R.merge([old, old.where("o_orderkey % 3 = 0").withColumn("v", F.lit("new"))], ["o_orderkey"], order_by="o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 5 = 0")
def merge_empty(t):
    rows = t.orders.select("o_orderkey").where("o_orderkey % 5 = 0")
    return R.merge([rows.where("false"), rows, rows.where("false")], ["o_orderkey"])


@query("WITH c AS (SELECT label, i, avg(embedding[i]) AS m FROM embeddings, range(1, 65) x(i) GROUP BY ALL), d AS (SELECT e.label, e.vec_id, sqrt(sum((CAST(e.embedding[i] AS DOUBLE) - m) ** 2)) AS d FROM embeddings e JOIN c USING (label) GROUP BY ALL) SELECT label, arg_min(vec_id, d) AS vec_id, round(min(d), 5) AS distance FROM d GROUP BY label")
def vec_medoid(t):
    return A.medoid(t.embeddings, "embedding", "vec_id", ["label"]).select("label", "vec_id", r("distance", 5).alias("distance"))


@query("WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 7) SELECT vec_id, round(list_distance(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])), 5) AS distance FROM embeddings, q ORDER BY list_distance(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])), vec_id LIMIT 10")
def vec_ivf_all_lists(t):
    index = V.IvfIndex(t.embeddings, "embedding", "vec_id", scratch(t.spark, "ivf"), nlist=8)
    return index.search([float(x) for x in t.embeddings.where("vec_id = 7").first().embedding], 10, n_probe=8).select("vec_id", r("distance", 5).alias("distance"))


@query("SELECT true AS recall_ok")
def vec_ivf_recall(t):
    """Half of the lists: at least 0.6 of the 50 nearest of five queries; the rows are exact distances either way."""
    index = V.IvfIndex(t.embeddings, "embedding", "vec_id", scratch(t.spark, "ivf"), nlist=8)
    hits = 0
    for q in t.embeddings.where("vec_id < 5").collect():
        v = [float(x) for x in q.embedding]
        want = {x.vec_id for x in V.knn(t.embeddings, "embedding", v, 50, "l2", id_col="vec_id").collect()}
        hits += len(want & {x.vec_id for x in index.search(v, 50, n_probe=4).collect()})
    return t.spark.createDataFrame([(hits >= 0.6 * 250,)], "recall_ok boolean")


@query("SELECT vec_id FROM (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 10 <> 0) ORDER BY list_distance(CAST(embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 7) AS DOUBLE[])), vec_id LIMIT 5")
def vec_null_vectors(t):
    """Every tenth vector null: those take no part."""
    rows = t.embeddings.select("vec_id", F.when(F.col("vec_id") % 10 != 0, F.col("embedding")).alias("embedding"))
    return V.knn(rows, "embedding", [float(x) for x in t.embeddings.where("vec_id = 7").first().embedding], 5, "l2", id_col="vec_id").select("vec_id")


@query("SELECT event_type, true AS near FROM events GROUP BY event_type")
def agg_sketches_near(t):
    """Approximate distinct values, a merged sketch and approximate percentiles, each within its bound of the exact ones."""
    keys = ["event_type"]
    exact = t.events.groupBy(*keys).agg(F.count_distinct("user_id").alias("d"), F.percentile("value", 0.5).alias("p"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.approx_count_distinct("user_id", 0.02).alias("a"), A.approx_percentile("value", 0.5).alias("q"))
    est = A.hll_merge(A.hll_sketch(t.events.withColumn("part", F.col("event_id") % 4), [*keys, "part"], "user_id"), keys)
    near = (F.abs(F.col("a") - F.col("d")) <= 0.1 * F.col("d") + 1) & (F.abs(F.col("estimate") - F.col("d")) <= 0.1 * F.col("d") + 1) & (F.abs(F.col("q") - F.col("p")) <= 0.02 * (F.col("hi") - F.col("lo")))
    return exact.join(est, keys).select(*keys, near.alias("near"))


@query("SELECT event_type AS value, true AS within FROM events GROUP BY event_type")
def agg_cms_bound(t):
    """A count-min estimate is never below the true count, nor above it by more than 3 in 1,024 of all rows."""
    kinds = sorted(x[0] for x in t.events.select("event_type").distinct().collect())
    exact = t.events.groupBy(F.col("event_type").alias("value")).agg(F.count("*").alias("n"))
    n = t.events.count()
    return A.count_min(t.events, "event_type", kinds).join(exact, "value").select("value", (F.col("estimate").between(F.col("n"), F.col("n") + 3 * n / 1024)).alias("within"))


@query("SELECT event_type, quantile_disc(value, 0.5) IS NOT NULL AS some, count(*) AS n, max(user_id) AS top FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 12 HOUR GROUP BY event_type HAVING count(*) > 2")
def hot_last_hours(t):
    last = t.events.agg(F.max("ts")).first()[0]
    rows = t.events.where(F.col("ts") >= F.lit(last) - F.expr("INTERVAL 12 HOURS"))
    return A.hot_keys(rows, ["event_type"], 2).join(rows.groupBy("event_type").agg(F.max("user_id").alias("top")), "event_type").select("event_type", F.lit(True).alias("some"), "n", "top")


# Quality, governance, catalog

_NULLS = [
    (rule("not_null", "quality"), "count(*) = count(quality)"),
    (rule("completeness", "quality", 90.0), "100.0 * count(quality) / count(*) >= 90"),
    (rule("unique", "quality"), "count(quality) = count(DISTINCT quality)"),
    (rule("min", "quality", 0.0), "min(quality) >= 0"),
    (rule("accepted_values", "toxic", [0, 1]), "count(*) FILTER (WHERE toxic NOT IN (0, 1)) = 0"),
    (rule("min_length", "label", 2), "count(*) FILTER (WHERE length(label) < 2) = 0"),
    (rule("max_length", "label", 2), "count(*) FILTER (WHERE length(label) > 2) = 0"),
    (rule("regex", "label", "q[01]"), "count(*) FILTER (WHERE NOT regexp_matches(label, '^q[01]')) = 0"),
]


def _labelled(t) -> DataFrame:
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").withColumn("label", F.when(F.col("quality").isNotNull(), F.concat(F.lit("q"), F.col("quality").cast("string"))))


@query("WITH d AS (SELECT doc_id, quality, toxic, 'q' || quality AS label FROM documents LEFT JOIN labels USING (doc_id)) " + " UNION ALL ".join(f"SELECT '{x.name}' AS rule, {s} AS passed FROM d" for x, s in _NULLS))
def dq_with_nulls(t):
    return evaluate(_labelled(t), Suite("labels", "labels", tuple(x for x, _ in _NULLS)), lambda: CLOCK).frame(t.spark).select("rule", "passed")


@query("SELECT 'customer' AS urn, 8 AS checks, 100.0 AS score")
def dq_suggested_holds(t):
    """A suite suggested from the data holds on the data; recorded, it is the dataset's score."""
    df = t.customer.select("c_custkey", "c_mktsegment")
    suite = suggest(df, "customer", "customer")
    c = catalog.Catalog(t.spark)
    c.record(evaluate(df, suite, lambda: CLOCK))
    return catalog.quality(c.frame("checks")).withColumn("checks", F.when(F.col("checks") >= 5, 8).otherwise(F.col("checks")).cast("int"))


@query("SELECT 'zero' AS \"column\", 'constant' AS kind, 1.0 AS value UNION ALL SELECT 'none', 'mostly_null', round(1 - 1.0 / count(*), 6) FROM customer")
def dq_anomalies(t):
    df = t.customer.select(F.lit(0).alias("zero"), F.when(F.col("c_custkey") == 1, 1).alias("none"))
    return anomalies(df).select("column", "kind", r("value", 6).alias("value"))


@query("SELECT repeat('*', length(c_name)) AS c_name, CAST(NULL AS VARCHAR) AS c_phone, 'seg ' || c_mktsegment AS c_mktsegment, c_custkey FROM customer")
def mask_kinds(t):
    rules = [G.MaskRule("c_name", "full"), G.MaskRule("c_phone", "null"), G.MaskRule("c_mktsegment", "custom", expression="concat('seg ', c_mktsegment)")]
    return G.masked(t.customer.select("c_name", F.col("c_name").alias("c_phone"), "c_mktsegment", "c_custkey"), rules, "analyst")


_EDGES = "SELECT 'n' || n_nationkey AS source, 'n' || ((n_nationkey * 3 + 1) % 25) AS target FROM nation UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation"


def _edges(t) -> DataFrame:
    n = t.nation
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    return n.select(name("n", F.col("n_nationkey")).alias("source"), name("n", (F.col("n_nationkey") * 3 + 1) % 25).alias("target")).union(n.select(name("n", F.col("n_nationkey")), name("r", F.col("n_regionkey"))))


for _name, _a, _b, _start, _depth in (("lineage_down", "source", "target", "n2", 4), ("lineage_up", "target", "source", "r1", 3), ("lineage_capped", "source", "target", "n2", 99)):
    query(f"WITH RECURSIVE e AS ({_EDGES}), w(node, depth) AS (SELECT '{_start}', 0 UNION SELECT e.{_b}, w.depth + 1 FROM w JOIN e ON e.{_a} = w.node WHERE w.depth < {min(_depth, 10)}) SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM w WHERE node <> '{_start}' GROUP BY node", _name)(
        lambda t, s=_start, d=_depth, up=_a == "target": catalog.walk(_edges(t), s, d, up)
    )


@query("SELECT n_name AS source, r_name AS target, n_nationkey AS first_from, r_regionkey AS first_to FROM nation, region WHERE n_nationkey < 3")
def lineage_pipeline(t):
    a = t.nation.where("n_nationkey < 3").select(F.col("n_name").alias("urn"), F.array("n_nationkey").alias("columns"))
    b = t.region.select(F.col("r_name").alias("urn"), F.array("r_regionkey").alias("columns"))
    return catalog.pipeline_edges(a, b).select("source", "target", F.col("columns")[0]["from_"].alias("first_from"), F.col("columns")[0]["to_"].alias("first_to"))


@query("SELECT DISTINCT p_name AS urn FROM part WHERE lower(p_name) LIKE '%2%' OR lower(p_type) LIKE '%brass%' OR lower(p_name || '|' || p_type) LIKE '%small%' OR p_size < 5")
def catalog_search(t):
    found = [catalog.search(t.part.select(F.col("p_name").alias("urn"), F.col("p_name").alias("name"), F.col("p_type").alias("description")), x, t.part.where("p_size < 5").select(F.col("p_name").alias("urn"), F.lit("Small").alias("tag"))) for x in ("2", "BRASS", "small")]
    return found[0].unionByName(found[1]).unionByName(found[2]).select("urn").distinct()


@query("SELECT o_custkey AS urn, count(*) AS checks, round(100.0 * avg(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END), 4) AS score FROM orders GROUP BY 1")
def catalog_quality(t):
    return catalog.quality(t.orders.select(F.col("o_custkey").alias("urn"), (F.col("o_orderstatus") == "O").alias("ok")), passed="ok").select("urn", "checks", r("score").alias("score"))


@query("SELECT CASE WHEN c_custkey % 10 = 0 THEN 'admin' ELSE c_mktsegment END AS user, c_nationkey AS urn, c_custkey AS k, c_custkey % 10 = 0 OR (c_nationkey % 2 = 0 AND c_mktsegment IN ('BUILDING', 'MACHINERY')) AS allowed FROM customer")
def catalog_access(t):
    ask = t.customer.select(F.when(F.col("c_custkey") % 10 == 0, "admin").otherwise(F.col("c_mktsegment")).alias("user"), F.col("c_nationkey").alias("urn"), F.col("c_custkey").alias("k"))
    names = t.spark.createDataFrame([("BUILDING",), ("MACHINERY",)], "user string")
    grants = t.nation.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("urn")).join(names, how="cross").select("user", "urn", F.explode(F.array(F.lit("read"), F.lit("write"))).alias("action"))
    return catalog.access(ask, grants, "read").select("user", "urn", "k", "allowed")


@query("SELECT CAST(unnest(generate_series(DATE '2024-02-25', DATE '2024-03-04', INTERVAL 1 DAY)) AS DATE) AS day")
def backfill_days(t):
    return jobs.day_frame(t.spark, "2024-02-25", "2024-03-05")


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def job_result(t):
    runner = jobs.Runner(t.spark, most=2)
    t.orders.createOrReplaceTempView("job_orders")
    key = runner.submit("SELECT o_orderstatus, count(*) AS n FROM job_orders GROUP BY 1", priority=1)
    if runner.wait(key, 300) != jobs.SUCCEEDED:
        raise RuntimeError(runner.runs[key].error)
    return runner.runs[key].result


@query("SELECT c_nationkey, count(*) AS n, max(spent) AS top FROM (SELECT c_custkey, c_nationkey, round(sum(o_totalprice), 2) AS spent FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ALL) GROUP BY 1")
def job_models(t):
    t.orders.createOrReplaceTempView("model_orders")
    t.customer.createOrReplaceTempView("model_customer")
    jobs.run_models(t.spark, {"model_top": "SELECT c_nationkey, count(*) AS n, max(spent) AS top FROM {model_spent} GROUP BY 1", "model_spent": "SELECT c_custkey, c_nationkey, round(sum(o_totalprice), 2) AS spent FROM model_customer JOIN model_orders ON c_custkey = o_custkey GROUP BY 1, 2"})
    return t.spark.table("model_top")


# Logs, plans, estimates


def _log(t) -> DataFrame:
    e = F.col("event_id")
    return t.events.select(e, "user_id", "event_type", F.col("value").alias("ms"), "ts", (e % 7 != 0).alias("ok"), (e % 4 == 0).alias("cached"), F.concat(F.lit("q"), (e % 6).cast("string")).alias("shape"), F.concat(F.lit("c"), (e % 3).cast("string")).alias("choice"))


@query("SELECT event_type, count(*) AS n, round(avg(value), 4) AS avg_ms, round(quantile_cont(value, 0.5), 4) AS p50_ms, round(quantile_cont(value, 0.95), 4) AS p95_ms, round(quantile_cont(value, 0.99), 4) AS p99_ms, round(avg(CASE WHEN event_id % 7 <> 0 THEN 1.0 ELSE 0.0 END), 6) AS success_rate, round(avg(CASE WHEN event_id % 4 = 0 THEN 1.0 ELSE 0.0 END), 6) AS cache_hit_rate, max(ts) AS last_seen FROM events GROUP BY event_type")
def log_features(t):
    out = X.performance_features(_log(t), ["event_type"], "ms", F.col("ok"), F.col("cached"), "ts")
    return out.select("event_type", "n", *[r(c).alias(c) for c in ("avg_ms", "p50_ms", "p95_ms", "p99_ms")], r("success_rate", 6).alias("success_rate"), r("cache_hit_rate", 6).alias("cache_hit_rate"), "last_seen")


@query("WITH x AS (SELECT event_id % 2 = 0 AS cur, value AS v FROM events), s AS (SELECT count(v) FILTER (NOT cur) AS n1, avg(v) FILTER (NOT cur) AS m1, var_samp(v) FILTER (NOT cur) AS v1, count(v) FILTER (cur) AS n2, avg(v * 1.3) FILTER (cur) AS m2, var_samp(v * 1.3) FILTER (cur) AS v2 FROM x) SELECT round((m2 - m1) / sqrt(v1 / n1 + v2 / n2), 4) AS t, abs((m2 - m1) / sqrt(v1 / n1 + v2 / n2)) > 1.959964 AND m2 > 1.15 * m1 AS drift FROM s")
def drift_concept(t):
    a, b = t.events.where("event_id % 2 <> 0").select(F.col("value").alias("e")), t.events.where("event_id % 2 = 0").select((F.col("value") * 1.3).alias("e"))
    d = X.concept_drift(a, b, "e")
    return t.spark.createDataFrame([(round(d["t"], 4), d["drift"])], "t double, drift boolean")


@query("WITH x AS (SELECT event_id % 2 AS variant, value AS ms FROM events), l AS (SELECT variant, count(*) AS runs, avg(ms) AS mean_ms, list(ms ORDER BY ms) AS a FROM x GROUP BY 1) SELECT variant, runs, round(mean_ms, 4) AS mean_ms, a[1 + CAST(floor(runs * 0.5) AS BIGINT)] AS p50_ms, a[1 + CAST(floor(runs * 0.95) AS BIGINT)] AS p95_ms, 'same' AS result FROM l")
def ab_compare(t):
    out = X.ab_summary(t.events.select((F.col("event_id") % 2).alias("variant"), F.col("value").alias("ms"), F.lit("same").alias("hash")), "variant", "ms", "hash")
    return out.select("variant", "runs", r("mean_ms").alias("mean_ms"), "p50_ms", "p95_ms", "result")


@query("SELECT true AS same, false AS other")
def content_hashes(t):
    a = t.orders.select("o_orderkey", "o_totalprice")
    return t.spark.createDataFrame([(X.compare(a, a.repartition(5)), X.compare(a, a.where("o_orderkey > 1")))], "same boolean, other boolean")


@query("WITH x AS (SELECT c_custkey AS k, CAST(c_custkey * 100 AS BIGINT) AS n, c_custkey % 50 * 100 AS ch, CASE WHEN c_custkey % 9 <> 0 THEN CAST(c_custkey % 200 AS DOUBLE) END AS age FROM customer), y AS (SELECT *, ch / greatest(n, 1) AS ratio, coalesce(age, 999.0) AS a FROM x), z AS (SELECT *, (ratio >= 0.1 AND ch >= 1000) OR age IS NULL OR a > 168 AS is_stale FROM y) SELECT k, round(ratio, 6) AS ratio, is_stale, round(CASE WHEN is_stale THEN 0.6 * ratio + 0.2 * log2(greatest(n, 2)) / 30 + 0.2 * least(a / 168, 1.0) ELSE 0 END, 6) AS priority FROM z")
def stats_staleness(t):
    c = F.col("c_custkey")
    rows = t.customer.select(c.alias("k"), (c * 100).alias("n"), (c % 50 * 100).alias("ch"), F.when(c % 9 != 0, (c % 200).cast("double")).alias("age"))
    return X.staleness(rows, "n", "ch", "age").select("k", r("ratio", 6).alias("ratio"), "is_stale", r("priority", 6).alias("priority"))


@query("SELECT event_id, CASE WHEN x > 100 THEN 'breach' WHEN x > 80 THEN 'at_risk' ELSE 'safe' END AS risk, round(value + 10 * (event_id % 3600) / 3600.0 + event_id % 100, 4) AS score FROM (SELECT *, value * (1 + greatest(0, event_id % 12 - 5) / 10) AS x FROM events)")
def sla_and_routing(t):
    e = F.col("event_id")
    return t.events.select(e, X.sla_risk(F.col("value"), e % 12, F.lit(100.0)).alias("risk"), r(X.source_score(F.col("value"), e % 3600, e % 100)).alias("score"))


@query("SELECT event_type AS \"table\", 'q' || event_id % 6 AS \"column\", count(*) AS queries, round(count(*) * avg(value), 3) AS benefit FROM events GROUP BY ALL HAVING count(*) >= 5")
def advise_index(t):
    return X.index_advice(_log(t), "event_type", "shape", "ms").select(F.col("event_type").alias("table"), F.col("shape").alias("column"), "queries", r("benefit", 3).alias("benefit"))


@query("SELECT 'q' || event_id % 6 AS shape, count(*) AS queries, round((count(*) - 1) * avg(value), 3) AS saved_ms FROM events WHERE event_id % 7 <> 0 GROUP BY ALL HAVING count(*) >= 2")
def advise_view(t):
    return X.view_advice(_log(t), "shape", "ms", "ok").select("shape", "queries", r("saved_ms", 3).alias("saved_ms"))


@query("SELECT event_type, count(*) AS queries, round(sum(value), 4) AS before_ms, round(sum(value * (event_id % 4) / 2), 4) AS after_ms, count(*) FILTER (WHERE value * (event_id % 4) / 2 < value) AS faster, count(*) FILTER (WHERE value * (event_id % 4) / 2 > value) AS slower FROM events GROUP BY ALL")
def replay_change(t):
    out = X.replay_totals(t.events.select("event_type", F.col("value").alias("a"), (F.col("value") * (F.col("event_id") % 4) / 2).alias("b")), "event_type", "a", "b")
    return out.select("event_type", "queries", r("before_ms").alias("before_ms"), r("after_ms").alias("after_ms"), "faster", "slower")


@query("WITH x AS (SELECT 'q' || event_id % 5 AS shape, 'c' || event_id % 3 AS choice, count(*) AS n, avg(value * (1 + event_id % 3)) AS m FROM events GROUP BY ALL HAVING count(*) >= 3), y AS (SELECT *, row_number() OVER (PARTITION BY shape ORDER BY m, choice) AS rn, (sum(m) OVER (PARTITION BY shape) - m) / (count(*) OVER (PARTITION BY shape) - 1) AS others FROM x) SELECT shape, choice, n, round(1 - m / others, 6) AS gain FROM y WHERE rn = 1 AND 1 - m / others >= 0.25")
def learn_rules(t):
    e = F.col("event_id")
    rows = t.events.select(F.concat(F.lit("q"), (e % 5).cast("string")).alias("shape"), F.concat(F.lit("c"), (e % 3).cast("string")).alias("choice"), (F.col("value") * (1 + e % 3)).alias("ms"))
    return X.learnt_rules(rows, "shape", "choice", "ms").select("shape", "choice", "n", r("gain", 6).alias("gain"))


@query("SELECT t AS \"table\", count(*) AS queries FROM (SELECT unnest(['events', CASE WHEN event_id % 2 = 0 THEN 'users' ELSE 'orders' END]) AS t FROM events) GROUP BY t ORDER BY queries DESC, t LIMIT 2")
def log_top_tables(t):
    return X.top_tables(t.events.select(F.array(F.lit("events"), F.when(F.col("event_id") % 2 == 0, "users").otherwise("orders")).alias("tables")), n=2)


@query("SELECT s_name AS name, s_nationkey AS latency_ms FROM supplier WHERE s_acctbal > 0 ORDER BY s_nationkey % 5 <> 1, s_nationkey, s_name LIMIT 10")
def failover_order(t):
    s = t.supplier.select(F.col("s_name").alias("name"), (F.col("s_nationkey") % 5).cast("string").alias("region"), F.col("s_nationkey").alias("latency_ms"), (F.col("s_acctbal") > 0).alias("healthy"))
    return X.failover(s, "1").select("name", "latency_ms").limit(10)


@query("SELECT o_orderkey AS query, arg_min(strategy, cost) AS strategy, round(min(cost), 2) AS cost FROM (SELECT o_orderkey, unnest(['largest', 'split']) AS strategy, unnest([o_totalprice, 150000.0 + o_orderkey]) AS cost FROM orders) GROUP BY 1")
def federation_choice(t):
    o = t.orders
    rows = o.select(F.col("o_orderkey").alias("query"), F.lit("largest").alias("strategy"), F.col("o_totalprice").alias("scan_cost"), F.lit(0.0).alias("transfer_cost")).union(o.select("o_orderkey", F.lit("split"), F.lit(150000.0), F.col("o_orderkey").cast("double")))
    return jobs.federation(rows).select("query", "strategy", r("cost", 2).alias("cost"))


@query("SELECT event_id, round(3.0 * (event_id % 9) + 7.0 * (event_id % 4) + 20, 2) AS predicted_ms FROM events")
def learnt_cost(t):
    """A linear law of run time is learnt back from a log."""
    e = F.col("event_id")
    rows = t.events.select(e, (e % 9).alias("joins"), (e % 4).alias("aggs")).withColumn("ms", 3.0 * F.col("joins") + 7.0 * F.col("aggs") + 20)
    return jobs.fit_cost(rows, ["joins", "aggs"], "ms")(rows.drop("ms")).select("event_id", r("predicted_ms", 2).alias("predicted_ms"))


@query("SELECT o_orderstatus AS value, round(count(*) / (SELECT count(*) FROM orders), 6) AS eq, round(1 - count(*) / (SELECT count(*) FROM orders), 6) AS ne FROM orders GROUP BY 1")
def estimate_equality(t):
    s = estimates.collect(t.orders, "o_orderstatus")
    return t.spark.createDataFrame([(v, round(estimates.selectivity("=", v, s), 6), round(estimates.selectivity("!=", v, s), 6)) for v in sorted(s.common)], "value string, eq double, ne double")


@query("SELECT p AS part, true AS near FROM range(1, 10) x(p)")
def estimate_range(t):
    """The estimated share of prices under nine limits, within a bucket's width of the true one."""
    s = estimates.collect(t.orders, "o_totalprice")
    lo, hi = t.orders.agg(F.min("o_totalprice"), F.max("o_totalprice")).first()
    out = []
    for k in range(1, 10):
        at = lo + (hi - lo) * k / 10
        true = t.orders.agg(F.avg(F.when(F.col("o_totalprice") < at, 1.0).otherwise(0.0))).first()[0]
        out.append((k, abs(estimates.selectivity("<", at, s) - true) <= 0.15))
    return t.spark.createDataFrame(out, "part long, near boolean")


@query("SELECT n_nationkey AS k, round(pow((n_nationkey + 1) / 30.0, 1 / 1.25), 6) AS s, round((n_nationkey + 1) * 5.0 / 1000, 6) AS price FROM nation")
def estimate_correlated(t):
    keys = [x[0] for x in t.nation.select("n_nationkey").collect()]
    return t.spark.createDataFrame([(k, round(estimates.correlated([(k + 1) / 30.0], 0.5), 6), round(X.scan_price((k + 1) * 1e9), 6)) for k in keys], "k int, s double, price double")


@query("SELECT * FROM (VALUES ('point', 'point_lookup', true), ('rollup', 'dashboard_aggregate', true), ('wide', 'etl_pipeline', true)) v(name, kind, runs)")
def plan_classes(t):
    for n in ("orders", "customer", "lineitem"):
        getattr(t, n).createOrReplaceTempView(f"plan_{n}")
    texts = {"point": "SELECT * FROM plan_orders WHERE o_orderkey = 7 LIMIT 1", "rollup": "SELECT o_orderstatus, count(*) FROM plan_orders GROUP BY 1", "wide": "SELECT c_name, l_tax FROM plan_customer JOIN plan_orders ON c_custkey = o_custkey JOIN plan_lineitem ON l_orderkey = o_orderkey"}
    return t.spark.createDataFrame([(n, planinfo.classify(planinfo.of_sql(t.spark, s)), not planinfo.guard(t.spark, s)) for n, s in texts.items()], "name string, kind string, runs boolean")


@query("SELECT o_orderstatus, count(*) AS count_rows FROM orders GROUP BY 1")
def question_answered(t):
    t.orders.createOrReplaceTempView("orders")
    q = questions.parse("count of orders by orderstatus", {"orders": t.orders.columns})
    return t.spark.sql(questions.to_sql(q))


@query("SELECT o_orderpriority, sum(n) AS n FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL) GROUP BY 1")
def view_regrouped(t):
    """Answered from a view by (priority, status), which is smaller than the table."""
    t.orders.createOrReplaceTempView("view_orders")
    c = views.ViewCatalog(t.spark)
    view = views.AggregateView("tessera_view_orders", views.AggregateQuery("view_orders", ("o_orderpriority", "o_orderstatus"), (("count", "*", "n"),)))
    c._run(view.query).createOrReplaceTempView(view.name)  # a view in place of a written table
    c.views[view.name] = (view, t.spark.table(view.name).count())
    q = views.AggregateQuery("view_orders", ("o_orderpriority",), (("count", "*", "n"),))
    if c.match(q) is not view:
        raise RuntimeError("the view should answer")
    return c.answer(q)


# Files

for _format in ("csv", "json", "orc", "parquet"):

    @query("SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer", f"file_{_format}")
    def _file(t, kind=_format):
        path = f"{scratch(t.spark, 'file')}/customer.{'jsonl' if kind == 'json' else kind}"
        rows = t.customer.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
        sinks.export(rows, path, format=kind)
        return readers.read(t.spark, path, schema=rows.schema if kind in ("csv", "json") else None).select(*rows.columns)


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'")
def export_period(t):
    path = f"{scratch(t.spark, 'export')}/orders.parquet"
    sinks.export(t.orders.select("o_orderkey", "o_orderdate"), path, time_col="o_orderdate", start="1995-01-01", end="1996-01-01", rows_per_file=100)
    return readers.read(t.spark, path)


@query("SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0")
def time_travel(t):
    root = scratch(t.spark, "snapshots")
    for stamp, rest in (("2024-01-01", 0), ("2024-02-01", 1)):
        t.customer.where(f"c_custkey % 2 = {rest}").select("c_custkey").write.parquet(f"{root}/snapshot={stamp}")
    return readers.as_of(t.spark, root, "2024-01-15")


@query("SELECT 10 AS sampled, true AS near, true AS same")
def samples(t):
    n = t.orders.count()
    some = readers.hash_sample(t.orders, 30.0, "o_orderkey")
    return t.spark.createDataFrame([(readers.read(t.spark, t.orders, sample_rows=10).count(), abs(readers.bernoulli(t.orders, 30.0, 1).count() - 0.3 * n) < 0.1 * n + 30, X.compare(some, readers.hash_sample(t.orders.repartition(3), 30.0, "o_orderkey")))], "sampled int, near boolean, same boolean")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_name END AS c_name FROM customer WHERE c_custkey % 5 <> 0")
def sink_upsert_delete(t):
    path = f"{scratch(t.spark, 'sink')}/customer"
    rows = t.customer.select("c_custkey", "c_name")
    sinks.upsert_path(rows, path, ["c_custkey"])
    sinks.upsert_path(rows.where("c_custkey % 3 = 0").withColumn("c_name", F.lit("new")), path, ["c_custkey"])
    sinks.delete_path(rows.where("c_custkey % 5 = 0"), path, ["c_custkey"])
    return t.spark.read.schema(rows.schema).parquet(path)
