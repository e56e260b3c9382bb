"""Times the headline queries: warm median of three runs each at $BENCH_SF_DIR on local[$BENCH_CPUS]. Prints one JSON line.

jobs: Spark jobs of a run. dq_one_by_one: the suite of dq_suite with a job for each rule, to compare with the fused one.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from tessera.queries import QUERIES
from tessera.session import local

HEADLINE = ["scan_project", "filter_compare", "join_multiway", "join_salted", "join_asof", "merge_upsert", "agg_basic", "agg_percentile_cont", "agg_cube", "win_ranks", "win_moving_avg", "topk", "vec_cosine_topk", "vec_spread", "dq_suite", "col_profile", "psi_drift", "sequence_pairs", "stream_tumbling", "sql_cte", "sql_lateral", "win_ema", "vec_medoid", "catalog_quality", "log_features", "dq_with_nulls"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local()
    spark.sparkContext.setLogLevel("ERROR")
    took, jobs = {}, {}
    rules = [n for n in QUERIES if n.startswith("dq_") and n not in ("dq_suite", "dq_suite_score", "dq_with_nulls", "dq_suggested_holds", "dq_anomalies")]
    work = {name: [name] for name in HEADLINE} | {"dq_one_by_one": rules}
    sc = spark.sparkContext
    for name, parts in work.items():
        runs = []
        for k in range(4):
            sc.setJobGroup(f"{name}-{k}", name)
            began = time.perf_counter()
            for part in parts:
                QUERIES[part](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(statistics.median(runs[1:]), 3)
        jobs[name] = len(sc.statusTracker().getJobIdsForGroup(f"{name}-3"))
    print(json.dumps({"metric": "sum of warm medians", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "jobs": jobs, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
