"""Time the headline queries; print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8) and
BENCH_RUNS (default 3) set the data, the cores and the timed runs per query.
Each time is the median of the runs after one warm-up.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from checks.compare import local_spark
from checks.star_queries import QUERIES

HEADLINE = (
    "validated_orders",
    "cohort_labels",
    "rfm_features",
    "item_features",
    "review_features",
    "payment_features",
    "snapshot_features",
    "modeling_dataset",
    "stratified_split",
    "fixed_scores",
    "confusion_matrix",
    "roc_auc",
    "curve_downsample",
    "decile_lift",
    "calibration",
    "scored_customers",
    "high_risk_customers",
    "tier_summary",
    "customer_explorer",
    "population_profile",
    "model_coefficients",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_spark(int(os.environ.get("BENCH_CPUS", "8")))
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
    result = {
        "metric": "total warm seconds of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }
    print(json.dumps(result), flush=True)


if __name__ == "__main__":
    main()
