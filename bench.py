"""Times the headline queries and prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rillwork.plans import load_registry
from rillwork.session import build_session

HEADLINE = (
    "timing_trend", "flow_duration", "mann_kendall", "typical_year", "phase_composites", "validation_metrics",
    "snow_balance", "yearly_flow", "downstream_accumulation", "strahler_order", "greedy_colors", "point_in_polygon",
    "shared_area", "nearest_reach", "duplicate_groups", "point_selection", "hillshade", "bilinear_samples",
    "completed_work", "product_analytics", "order_lifecycle_batch", "classify_waterbodies",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g")})
    spark.sparkContext.setLogLevel("ERROR")
    registry = load_registry()
    spark.read.parquet(f"{folder}/lineitem.parquet").count()
    times: dict[str, float] = {}
    for name in (chosen.split(",") if chosen else HEADLINE):
        start = time.perf_counter()
        registry[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
