"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from rillflow.plans import catalogue
from rillflow.session import session

HEADLINES = (
    "hot_items_top3", "hop_count", "hop_count_panes", "tumble_count", "session_count", "uv_exact_hourly", "uv_approx_hourly", "running_sum", "keyed_stats", "count_window_tumbling",
    "interval_join", "window_join", "regular_join", "reconcile", "cep_three_fails", "cep_next_within_timeout", "late_split", "allowed_lateness", "word_count", "trigger_each_element",
)


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", shuffle_partitions=int(cpus), **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINES:
        runs = []
        for _ in range(3):
            began = time.time()
            catalogue.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        seconds[name] = round(statistics.median(runs), 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": folder.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
