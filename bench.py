"""Time the headline queries and print one JSON line.

BENCH_SF_DIR   input tables (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_ALL=1    every registered query instead of the headline list
BENCH_ONLY     comma-separated query names
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from freshet.catalog import QUERIES  # noqa: E402
from freshet.session import local_session  # noqa: E402

HEADLINE = [
    "flow_flagship", "qc_stats", "qc_buffer", "dedup_conflict", "nondetect_dl2", "join_interp", "join_align", "join_assemble",
    "join_asof_last", "join_window_stats", "win_antecedent", "win_rain_lag", "grid_interp", "grid_features", "win_rolling_min",
    "load_compare", "evt_detect", "agg_site_metrics", "agg_summary", "smp_bootstrap_sites", "smp_calibration", "reg_global_logo",
    "reg_ridge_logo", "adapt_bayes", "adapt_curve", "pi_interp", "dia_disaggregate", "app_score", "st_wilcoxon", "dq_hash",
    "src_incremental", "ml_cv",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = list(QUERIES) if os.environ.get("BENCH_ALL") else HEADLINE
    if os.environ.get("BENCH_ONLY"):
        names = os.environ["BENCH_ONLY"].split(",")
    spark = local_session(cpus, "bench")
    spark.read.parquet(f"{sf_dir}/orders.parquet").count()  # start the executor before timing
    times: dict[str, float] = {}
    for n in names:
        t0 = time.perf_counter()
        QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.perf_counter() - t0, 3)
        print(f"{n} {times[n]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total wall-clock of headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": cpus, "spark": spark.version,
        "shuffle_partitions": int(spark.conf.get("spark.sql.shuffle.partitions")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
