"""Headline timings: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fintrail.operators import twin as TW
from fintrail.plans import catalog, tables as T
from fintrail.session import get_spark

HEADLINE = [
    "features_90d", "a1_window_type_sums", "a15_salary_spike", "a18_top3_concentration", "a19_window_summary",
    "a33_flow_concentration", "cls1_merchant_rules", "v2_scam_probability", "w1_interval_regularity", "w2_rolling_flags",
    "w3_stateful_flags", "j4_as_of_join", "r17_triggers", "g2_collapse", "g3_pagerank", "g4_strong_components", "g7_cycle_metrics",
    "p3_fan_chart", "p7_scenario_overlay", "m4_auc", "m5_knn_impute", "j10_nearest_vectors", "st5_trailing_summary", "st6_stateful_flags", "v7_deception",
]
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    spark = get_spark("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        # the tables are single small files here: smaller splits keep all cores busy without another plan
        "spark.sql.files.maxPartitionBytes": "256k", "spark.sql.files.openCostInBytes": "64k", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    plans = {n: catalog.QUERIES[n] for n in HEADLINE}
    plans["twin_snapshots"] = lambda s, p: TW.snapshots(T.ev(s, p))
    times: dict[str, float] = {}
    for name, fn in plans.items():
        if only and name not in only:
            continue
        took = []
        for _ in range(RUNS + 1):                     # the first run warms up
            t = time.perf_counter()
            fn(spark, d).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - t)
        times[name] = round(statistics.median(took[1:]), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(d.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
