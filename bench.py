"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the local cores,
BENCH_RUNS the warm runs of which the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

import checks.jobs  # noqa: F401  (registers)
from checks.queries import REGISTRY

HEADLINE = (
    "campus_overview",
    "scope_breakdown",
    "top_buildings_quarter",
    "top_buildings_range",
    "buildings_vs_campus_average",
    "carbon_footprint_summary",
    "monthly_building_mom",
    "building_efficiency",
    "building_performance",
    "building_performance_ranked",
    "building_type_summary",
    "energy_trends_daily",
    "peak_hours",
    "energy_listing",
    "user_footprint",
    "user_transport_patterns",
    "user_transport_patterns_partitioned",
    "department_summary",
    "user_vs_campus_average",
    "trip_listing",
    "trip_listing_admin",
    "initiative_effectiveness",
    "initiative_status_breakdown",
    "daily_dashboard",
    "daily_summary",
    "upsert_trips",
    "validate_trips",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("cinderbook-bench")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        if name not in REGISTRY:
            continue
        times = []
        for _ in range(runs + 1):
            started = time.perf_counter()
            REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - started)
        seconds[name] = round(statistics.median(times[1:]), 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, sum of warm medians",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
