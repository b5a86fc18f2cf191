"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one warm-up and the median of three runs each; prints one JSON line."""

from __future__ import annotations

import json
import os
import time
from statistics import median

HEADLINE = [
    "s1_parquet_scan", "w2_topk_ratio_per_group", "a7_loss_summary", "w6_utility", "d2_flat_many_groups", "d8_greedy_multiplicative", "d12_sweep_memberships", "d11_run_metrics", "a9_vendi", "a11_mean_cosine",
    "a24_participation", "a26_masks", "a8_curve_summary", "a21_adjacent_jaccard", "j7_anti", "j12_null_safe_match", "j14_knn_join", "j17_plane_neighbours", "x4_interpolation", "a14_coverage", "g1_dbscan", "m5_overlay",
    "m8_published_view", "m7_index_metrics", "a5_tags", "q1_cross_filter", "q2_histogram", "o4_top_k", "w8_neighbours", "p15_hash_sample",
]


def main() -> None:
    from pyspark.sql import SparkSession

    cpus = os.environ.get("BENCH_CPUS", "8")
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from vectide.queries import QUERIES

    def once(name: str) -> float:
        begin = time.perf_counter()
        QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - begin

    took = {}
    for name in HEADLINE:
        once(name)
        took[name] = round(median(once(name) for _ in range(3)), 4)
    print(json.dumps({"metric": "headline queries, sum of medians", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(d.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
