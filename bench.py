"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from outboxlake.plans.registry import QUERIES  # noqa: E402
from outboxlake.session import configure  # noqa: E402

HEADLINE = (
    "schedule_deliveries",
    "validate_callbacks",
    "m_invalid_callbacks_total",
    "due_deliveries",
    "due_deliveries_batch",
    "revalidate_due",
    "apply_attempts",
    "sign_requests",
    "sweep_external",
    "stats_totals",
    "stats_by_callback",
    "dead_letters",
    "external_pending_ages",
    "apply_commands",
    "terminal_events",
    "apply_retention",
    "m_dispatch_duration",
    "recover_cursor",
    "load_events",
    "stream_schedule",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("outboxlake-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    spark.range(1).count()
    keys = sys.argv[1:] or HEADLINE
    times: dict[str, float] = {}
    for key in keys:
        start = time.perf_counter()
        QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[key] = round(time.perf_counter() - start, 3)
    spark.stop()
    line = {
        "metric": "total_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
