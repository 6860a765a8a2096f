"""Time the headline queries; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [query ...]

Every query runs whole into a ``noop`` sink. Table queries run twice and the faster run
counts, as the first one mostly measures how the JVM warms up; training runs once.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from basketline.plans.catalog import QUERIES

HEADLINE = [
    "user_counts",
    "review_stats",
    "stats_json",
    "user_importance",
    "top_users",
    "top_user_reviews",
    "user_features",
    "item_features",
    "seq_full_row",
    "seq_orders",
    "seq_with_static",
    "split_cap",
    "derived_entropy",
    "baseline_validation",
    "top3_accuracy",
    "class_report",
    "ingest_lenient",
    "incremental_counts",
    "ml_logreg",
    "ml_tree",
    "ml_gbt",
]


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", os.environ.get("BENCH_SCRATCH") or tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = session(cpus)
    seconds = {}
    for name in names:
        times = []
        for _ in range(1 if name.startswith("ml_") else 2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(min(times), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": int(cpus),
                "runs": "best of 2, ml_* once",
            }
        )
    )


if __name__ == "__main__":
    main()
