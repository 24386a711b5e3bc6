"""Time the headline queries, fits last, and print one JSON line with all times so far after each.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tablewright import catalog  # noqa: E402
from tablewright.session import local_session  # noqa: E402

HEADLINE = [
    "profile_columns", "profile_duplicates", "top_values", "target_correlations", "correlation_matrix", "iqr_outliers",
    "clean_dedup", "fill_median", "fill_mode", "clip_iqr", "clean_chain", "feat_set", "feat_word_count",
    "feat_category_frequency", "modeling_table", "split_exact", "split_stratified", "prep_standardize", "metric_auc",
    "metric_prf_binary", "knn_topk", "metric_silhouette", "density_clusters", "registry_best", "train_ridge_regression",
    "train_random_forest_regressor",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    # One untimed scan, so that the first query does not pay for starting up.
    catalog.QUERIES["profile_shape"](spark, folder).collect()
    scale = float(os.path.basename(folder.rstrip("/")).removeprefix("sf"))
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr)
        # After each query the line so far, so that a stopped run still has its numbers; the last line holds them all.
        total = round(sum(times.values()), 3)
        print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": scale}), flush=True)


if __name__ == "__main__":
    main()
