"""Time the registered queries: one JSON line. BENCH_SF_DIR, BENCH_CPUS and BENCH_QUERIES choose what runs."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from outlyr.plans import registry

HEADLINE = (
    "robust_zscore_events", "robust_z_cells", "threshold_cells", "background_fraction", "resolution_quota", "common_keys",
    "nearest_neighbours", "local_strength", "hit_probability", "rank_by_site", "merge_best_build", "contour_levels", "event_table",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [x for x in os.environ.get("BENCH_QUERIES", "").split(",") if x] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for n in names:
        runs = []
        for _ in range(3):  # the first warms up
            t = time.perf_counter()
            registry.QUERIES[n](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t)
        took[n] = round(statistics.median(runs[1:]), 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
