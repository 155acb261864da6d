"""Wall time of the headline queries, one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from keystrand.plans import catalog

HEADLINE = ["kv_range_scan", "kv_multi_get", "kv_merge_view", "flush_compact", "bulk_load_fill_pages", "asof_segment_lookup", "agg_sum_median", "join_inner_3way", "hist_equi_depth", "segments_build"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/orders.parquet").count()
    took = {}
    for name in HEADLINE:
        start = time.time()
        catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf.rstrip("/").rpartition("/sf")[2]}))


if __name__ == "__main__":
    main()
