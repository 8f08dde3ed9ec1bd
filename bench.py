"""Times the headline queries on the given tables and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from gaugeworks.plans import catalog
from gaugeworks.session import local_session

HEADLINE = (
    "w01_integrate", "w02_sessions", "w04_peaks", "w05_gap", "w06_counter", "w09_window_choice",
    "j01_match", "j04_asof", "j05_nearest", "j06_interval", "j07_range", "j10_alias", "j12_or_match",
    "j19_reconcile", "a01_daily", "a07_summary", "a13_trends", "a14_day_shares", "a18_host_windows",
    "a22_event_merge", "a27_network_sum", "a29_worst_status", "a31_log_summary", "b12_title_attrs",
    "b16_redact_log", "b19_list_parse", "b22_topic", "f01_first_reason", "k01_insert_ignore",
    "s09_page_listings", "t02_topn", "t11_top_process", "x01_throttle", "x05_alerts",
)


def run(spark, fn, sf_dir: str) -> float:
    began = time.perf_counter()
    fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, "gaugeworks-bench")
    queries = catalog.queries()
    wanted = sys.argv[1:] or HEADLINE
    times = {}
    for name in wanted:
        run(spark, queries[name], sf_dir)  # first run compiles and warms the caches
        times[name] = round(run(spark, queries[name], sf_dir), 3)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
