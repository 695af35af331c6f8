"""Time the headline queries and print one JSON line.

Reads BENCH_SF_DIR (default /root/testdata/sf0.1) on local[BENCH_CPUS]. Each
query runs once cold and once warm, its full result going to Spark's no-op sink, so
every column of every row is computed and nothing is collected. "queries" holds the
warm times, "cold" the first ones, which include shared tables and models; the
six out-of-fold fits at full settings are the cold time of cross_validate and are
listed as "training".
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from lagline.plans.catalog import QUERIES

HEADLINE = [
    "order_dataset",
    "order_features",
    "aggregate_items",
    "delay_by_promised_range",
    "delay_by_items",
    "delay_by_sellers",
    "delay_by_state",
    "delay_by_month",
    "cumulative_orders_by_items",
    "describe_promised_days",
    "profile_columns",
    "dq_failures",
    "stratified_split",
    "exact_stratified_sample",
    "except_distinct",
    "threshold_curve",
    "roc_auc",
    "cross_validate",
    "evaluate_model",
    "score_orders",
    "shap_values",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lagline-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="lagline-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    cold, seconds = {}, {}
    for name in names:
        for taken in (cold, seconds):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "cold": cold,
                "training": cold.get("cross_validate"),
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
