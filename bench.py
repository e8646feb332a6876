"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from corpusgauge.caching import release  # noqa: E402
from corpusgauge.plans.queries import QUERIES  # noqa: E402
from corpusgauge.session import local_session  # noqa: E402

HEADLINE = (
    "scan_manifest summarize_manifest split_validation near_duplicate_pairs resolve_drops dedupe_report resume_todo "
    "rank_detections square_crop group_quantiles build_test_sets per_source_rates ranking_metrics ece full_report "
    "bootstrap_ci robustness_metrics uncertainty_band calibrate gradcam_map mean_spectrum sliding_rate_limit "
    "early_stop stream_progress"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4)), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_orderstatus").count().collect()
    took = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
        release()
    total = round(sum(took.values()), 3)
    name = os.path.basename(sf_dir.rstrip("/"))
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": took, "sf": name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
