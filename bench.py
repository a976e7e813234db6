"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from flowsieve.catalog import all_queries  # noqa: E402
from flowsieve.session import builder  # noqa: E402

HEADLINE = [
    "frames_decode", "filter_noise", "capture_funnel", "flows_idle", "flows_assemble", "flow_features", "minmax_fit",
    "decide", "decision_counts", "block_intervals", "enforce_dropped", "notify_accept", "eventlog_scan", "kpi_counts",
    "kpi_windowed", "corpus_clean", "cap_per_class", "stratified_split", "median_fit", "standard_fit", "dataset_summary",
    "model_metrics", "alert_rates", "explain_text",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (builder("bench").master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus)
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "12g").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    queries = all_queries()
    warm = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(warm):   # JVM start-up and code loading are not what is measured
        queries["decision_counts"](spark, warm).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
