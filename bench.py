"""Headline queries, warm: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 3),
BENCH_ONLY (comma-separated query names).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from capsonde.session import build_session  # noqa: E402
from workload import all_queries  # noqa: E402

HEADLINE = [
    "f6_lobo_diff_mean",
    "f5_within_auc",
    "f9_transfer_matrix",
    "f10_length_confound",
    "f19_method_comparison",
    "f14_best_feature",
    "f17_best_token",
    "f4_rank_sum_auc",
    "e6_stratified_negatives",
    "e10_average_ranks",
    "e5_probe_texts",
    "j3_final_abilities",
    "d5_summary_counts",
    "d13_removed_mappings",
    "c6_patched_texts",
    "f20_best_depth_table",
    "a8_manifest",
    "b19_picked_splits",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    only = [q for q in os.environ.get("BENCH_ONLY", "").split(",") if q] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "16g",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-"),
            "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    known, seconds = all_queries(), {}
    for name in only:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            known[name](spark, sf).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken[1:]), 3)
        print(f"{name}: cold {taken[0]:.2f}s, warm {seconds[name]:.2f}s", file=sys.stderr)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": sf.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
