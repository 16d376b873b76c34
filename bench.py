"""Time the headline queries: one JSON line on stdout."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tripline.queries import queries

HEADLINE = (
    "located_with_place",
    "country_stays",
    "city_stays",
    "leader_clusters",
    "rebuild_timelines",
    "timeline_document",
    "poi_rollup",
    "estimate_cells",
    "enrich_places",
    "link_media",
    "match_sidecars",
    "ingest_classify",
    "upsert_media",
    "export_gpx",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tripline-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        began = time.perf_counter()
        queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    seconds, first = {}, {}
    for name in HEADLINE:
        # The first run also derives the sample tables and warms the JVM; it is kept apart.
        first[name] = round(run(name), 3)
        seconds[name] = round(run(name), 3)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries, second run",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "first_run": first,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
