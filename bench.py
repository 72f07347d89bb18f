"""Time the headline queries; prints one JSON line.

Every query is run once to warm up and then ``BENCH_RUNS`` times (3); the median counts. Results go
to the ``noop`` sink, so all rows are computed and none is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from waybill.plans import catalog
from waybill.session import build_session

HEADLINE = [
    "shipment_summary", "hub_performance", "daily_summary", "daily_analytics_rollup", "dashboard",
    "status_breakdown", "top_routes", "avg_delivery_days", "page_newest", "lookup_shipment",
    "exists_check", "insert_ignore", "assign_tracking", "create_shipments", "apply_patches",
    "delete_by_key", "append_events", "event_timeline", "filter_status_changed", "hub_load_fold",
    "validate_shipments", "unique_violations", "fk_orphans", "integrity_report", "sink_json",
    "gen_volume_m3",
]


def seconds(run, spark, folder) -> float:
    start = time.perf_counter()
    run(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main(names: list[str]) -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    todo = {n: catalog.QUERIES[n] for n in names or HEADLINE if n in catalog.QUERIES}
    took = {}
    for name, run in todo.items():
        seconds(run, spark, folder)
        took[name] = round(statistics.median(seconds(run, spark, folder) for _ in range(runs)), 3)
        print(f"{name}: {took[name]}", file=sys.stderr)
    total = round(sum(took.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec",
                      "queries": took, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main(sys.argv[1:])
