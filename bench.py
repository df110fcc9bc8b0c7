"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one line of JSON."""

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from vantor.queries import queries

HEADLINE = ("knn_l2", "knn_cosine", "knn_dot", "knn_hamming", "knn_label", "batch_knn_label", "live_knn", "live_counts", "distance_l2", "packed_distances", "sparse_measures", "payload_filter", "digests", "set_cardinality", "set_runs_all", "top_of_each")
#: Timed runs of each query after one that isn't timed; the median counts.
RUNS = 3


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        query, times = queries()[name], []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            query(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        took[name] = round(statistics.median(times[1:]), 4)
    print(json.dumps({"metric": "headline queries, sum of medians of warm runs", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
