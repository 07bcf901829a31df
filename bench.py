"""Benchmark: wall time of the headline queries at one scale factor.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma list, default the headline set). Each query is forced
to completion with the ``noop`` sink (all rows computed, nothing collected).
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import platform
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "classify",
    "category_summary",
    "enrich",
    "anomaly_flags",
    "exclude_rows",
    "display_rounding",
    "flag_counts",
    "label_queue_priority",
    "queue_merge",
    "queue_apply",
    "feature_table",
    "grouped_split",
    "split_class_counts",
    "confusion_matrix",
    "latest_label_join",
    "csv_null_tokens",
    "file_drop_stream",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]

    from transitlab.plans.queries import registry
    from transitlab.session import local_session

    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) * 2, app="transitlab-bench")
    reg = registry()
    # Warm-up (JIT, class loading) on the smallest fixture; not timed.
    reg["category_summary"](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}
    for name in names:
        t0 = time.perf_counter()
        reg[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "total_wall_time_headline_queries",
        "value": total,
        "unit": "sec",
        "queries": times,
        "sf": sf,
        "cpus": int(cpus),
        "hardware": f"{platform.machine()} {os.cpu_count()} cores, local[{cpus}]",
    }))
    spark.stop()


if __name__ == "__main__":
    main()
