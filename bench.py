"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from riskgrain.plans import catalog
from riskgrain.session import local_session

HEADLINE = (
    "v1_application", "bureau_features_v2", "installment_features_v3", "feature_mart_v3", "source_contract",
    "mart_contract", "raw_rules", "stratified_split", "numeric_summary", "feature_profile", "target_category",
    "binary_metrics", "topk_scenarios", "risk_deciles", "calibration_summary", "subgroup_metrics", "exact_top_k",
    "record_errors",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench", **{"spark.sql.shuffle.partitions": cpus})
    # start the JVM's code paths before the clock runs
    catalog.QUERIES["v1_application"](spark, folder).write.format("noop").mode("overwrite").save()
    took: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec",
                "queries": took, "sf": os.path.basename(folder.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
