"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the local threads (default 8),
BENCH_RUNS the timed runs after one warm-up run (default 2; the median counts).
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark.plans.queries import QUERIES  # noqa: E402
from tidemark.session import build_session  # noqa: E402

HEADLINE = [
    "gated_cumulative_rate", "cumulative_rate", "final_assembly", "protocol_splice", "audit_counts", "late_jump_flag",
    "seed_zero_fill", "seed_dead_fill", "ledger_apply", "anti_rule_table", "anti_all_columns", "full_outer_multi",
    "pivot_values", "second_last_visit", "season_end_gate", "group_stats", "hot_group_median", "copy_edit_insert",
    "fit_logistic3", "fit_gompertz4", "model_share", "predict_grid", "combined_predictions",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", int(cpus), **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
    scale = re.search(r"sf([\d.]+)", folder)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": float(scale.group(1)) if scale else None, "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
