"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "scan_events", "validate_rows", "validate_unique_events", "retention_summary", "retention_outcomes", "wallet_daily",
    "entry_cohorts", "weekly_repeat", "cohort_heatmap", "activity_intensity", "exclude_top_percent",
    "event_quality_profile", "daily_quality", "cohort_intersection", "full_outer_match", "densify_dates",
    "retention_metrics_long", "landmark_samples", "split_summary", "feature_shift", "evaluate_scores",
    "subgroup_metrics", "reliability_bins", "reward_epoch_summary", "reconcile_daily", "compare_tables",
    "score_logistic", "score_boosting", "score_mlp", "permutation_importance", "model_metrics",
)


def main() -> None:
    from pyspark.sql import SparkSession
    from recohort.suite import QUERIES

    spark = (SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "12g")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    # Start-up is not part of any query.
    spark.read.parquet(f"{FOLDER}/orders.parquet").groupBy("o_orderstatus").count().collect()
    seconds = {}
    for name in HEADLINE:
        began = time.perf_counter()
        # The sink takes every row, so nothing is pruned away and nothing is pulled to the driver.
        QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries, cold, total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": FOLDER.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
