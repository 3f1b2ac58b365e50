"""Headline queries, timed: prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores (default 8).
Each query is run to the end three times with its result discarded; the median counts.
Before that every query runs once on the smallest tables (if they lie beside the folder),
which warms the JVM up.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "violation_rate_month",
    "violation_heatmap",
    "station_means",
    "exposure",
    "station_week_pivot",
    "pivot_completeness",
    "timeline_rebuild",
    "year_align",
    "reconcile_orders",
    "coverage",
    "coverage_gaps",
    "missing_params",
    "discover_locations",
    "first_event",
    "tail_stats",
    "tail_stats_by_station",
    "survival_curve",
    "survival_curve_by_station",
    "p99_exceedance",
    "histogram_63",
    "histogram_fd",
    "value_order",
    "correlation_matrix",
    "pca6_scores",
    "zone_separation",
    "feature_table",
    "scan_order",
    "long_scan",
    "readings_subset",
    "ingest_increment",
]


def main() -> None:
    from stationlake.catalog import QUERIES
    from stationlake.session import get_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(min(8, os.cpu_count() or 1)))
    spark = get_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-"),
        },
    )
    spark.sparkContext.setLogLevel("OFF")

    def run(name: str, tables: str) -> None:
        QUERIES[name](spark, tables).write.format("noop").mode("overwrite").save()

    wanted = sys.argv[1:] or HEADLINE
    small = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001")
    for name in wanted if os.path.isdir(small) else wanted[:1]:
        run(name, small if os.path.isdir(small) else folder)
    times = {}
    for name in wanted:
        took = []
        for _ in range(3):
            began = time.perf_counter()
            run(name, folder)
            took.append(time.perf_counter() - began)
        times[name] = round(statistics.median(took), 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, total wall time",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
