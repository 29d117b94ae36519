"""Time the headline queries: one JSON line on stdout.

BENCH_SF_DIR names the data, BENCH_CPUS the local threads. Each query is timed once,
from building the plan to the last row; nothing is cached between queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "trailing_mean_score", "sum_duplicates", "monthly_totals", "dense_calendar", "upsert_keep_last",
    "merge_sum", "sheet_to_long", "score_whole_panel", "group_mean_features", "rolling_inclusive",
    "rolling_medians", "ewma_daily", "daily_feature_frame", "batch_scoring", "positional_split", "allocate_exact",
    "run_rate_forecast", "metrics_by_category", "rolling_origin_metrics", "executive_summary",
    "ar5_forecast_score", "monthly_models", "incremental_update", "recursive_monthly_forecast",
    "stream_upsert", "stream_live_windows",
]
PUBLISHED = {"score_whole_panel": (46.96, "scoring of 226,455 rows"), "daily_feature_frame": (5.0, "load and daily features"),
             "incremental_update": (0.64, "update with 65 rows"), "batch_scoring": (0.2, "scoring of 812 rows")}


def main() -> None:
    from saleloom.catalog import QUERIES
    from saleloom.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "bench")
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()  # start the session outside the timings
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "published": PUBLISHED, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
