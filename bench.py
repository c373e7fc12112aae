"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from plumbline.plans import QUERIES
from plumbline.runtime import local_session

HEADLINE = [
    "s2_json_lines", "c1_table_profile", "c2_json_profile", "c3_array_profile", "k14_quality_summary", "k25_permutation_threshold",
    "m8_cross_validated_grid", "m13_replacement_effects", "f1_law_fit", "f3_leave_group_out", "f7_candidate_folds", "f13_parameter_bootstrap",
    "a2_grid_argmin", "a10_replicate_optima", "e10_running_frontier", "v2_domain_metrics", "v8_subset_metrics", "i2_rolling_origin",
    "i5_cluster_ols", "i6_bh_qvalues", "b1_mean_intervals", "b3_cluster_gain",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, partitions=int(cores) if cores.isdigit() else 8)
    spark.read.parquet(f"{folder}/nation.parquet").groupBy("n_regionkey").count().collect()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
