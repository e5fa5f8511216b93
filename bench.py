"""Wall time of the headline queries: one JSON line on stdout.

Every query runs twice in one session; the second, warm run counts. A run covers
the query function and writing all of its rows to nowhere.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from foldwright.plans.catalog import QUERIES  # noqa: E402
from foldwright.session import local_session  # noqa: E402

HEADLINES = [
    "parse_agents",
    "value_counts",
    "column_n_unique",
    "constant_columns",
    "low_cardinality_columns",
    "within_group_max_std",
    "duplicate_rows",
    "preprocess_matches",
    "one_hot",
    "standardise_fit_apply",
    "seeded_shuffle",
    "permute_column",
    "ordered_split",
    "balanced_group_folds",
    "target_balanced_folds",
    "fold_summary",
    "cv_category_mean",
    "rmse_by_fold",
    "reconcile_predictions",
    "permutation_importance_linear",
    "feature_elimination_round",
    "knn_softmax_exact",
    "near_duplicate_vectors",
    "boosted_regression",
    "score_with_callback",
    "stream_score",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    times = {}
    for name in HEADLINES:
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    line = {"metric": "total_warm_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": scale}
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
