"""Time the headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; print one JSON line.

Each query is run once to warm up and then `BENCH_RUNS` times; the median counts. Results
go to Spark's no-op sink, so every row is computed and none is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from millrace.catalog import QUERIES
from millrace.session import build_session

HEADLINE = [
    "curated", "reject_reasons", "copies_dropped", "unseen_texts", "outcome_rates", "completion_report", "code_checked",
    "quota_sample", "quota_shortfall", "template_texts", "exact_split_rows", "usage_totals", "usage_by_user", "dataset_totals",
    "batch_success", "spend_alerts", "paired_orders", "recent_means", "recent_means_one_series", "adaptive_clips", "rate_audit",
    "rate_audit_one_limiter", "scaled_to_norm", "step_sizes", "paired_vector_gaps", "scores", "leaderboard", "pass_at_k",
    "report_lines", "turn_pairs", "fixed_width_rows", "line_facts", "json_split_files", "parquet_split_files",
    "stream_outcome_counts", "stream_sliding_totals",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        taken = []
        for _ in range(runs + 1):
            begin = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - begin)
        seconds[name] = round(statistics.median(taken[1:]), 3)
        print(f"{name:28s} {seconds[name]:7.3f}", file=sys.stderr)
    total = round(sum(seconds.values()), 3)
    scale = folder.rstrip("/").rsplit("sf", 1)[-1]
    try:
        scale = float(scale)
    except ValueError:
        pass
    print(json.dumps({"metric": "total_seconds_headline_queries", "value": total, "unit": "sec", "queries": seconds, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
