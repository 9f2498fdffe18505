"""Runs the headline queries and prints one JSON line: seconds a query, their sum, and rows a second of the folds.

BENCH_SF_DIR: the tables (default /root/testdata/sf0.1); BENCH_CPUS: cores (8).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from brindle import queries as Q  # noqa: E402

HEADLINE = ["pk_lookup", "pk_range", "filter_eq", "filter_between", "join_pk", "join_three", "join_self_lt", "exists_corr", "not_in_sub", "scalar_eq", "nested_two_level", "count_star", "sum_int", "sum_decimal", "avg_half_even", "count_distinct", "group_join", "order_topk"]
FOLDS = ["count_star", "sum_int", "sum_decimal", "avg_half_even", "count_distinct"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    for name in HEADLINE:
        runs = []
        for _ in range(3):  # the first compiles
            began = time.perf_counter()
            Q.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(statistics.median(runs[1:]), 4)
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/")), "rows_per_s": {n: round(rows / took[n]) for n in FOLDS}}))


if __name__ == "__main__":
    main()
