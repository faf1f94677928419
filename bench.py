"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
the data and the number of local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from plumbline.catalog import QUERIES  # noqa: E402
from plumbline.session import local_session  # noqa: E402

HEADLINES = [
    "numeric_summary", "iqr_outliers", "correlation_matrix", "correlation_matrix_with_nulls", "distinct_counts",
    "categorical_summary", "value_counts", "duplicate_count", "dedup_rows", "clean", "dataset_types",
    "interpolate_linear", "seasonal_decompose", "dominant_periods", "kruskal_by_phase", "forecast_readiness_full",
    "row_series_profile", "forward_fill", "location_stats", "regional_stats", "text_stats", "vocabulary_stats",
    "common_words", "lexicon_sentiment", "text_histograms", "histogram", "regression_readiness", "pca_variance",
    "kmeans_elbow",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    wanted = sys.argv[1:] or HEADLINES
    # One small query starts the executors and the code generator, so that the first time is not theirs.
    QUERIES["column_roles"](spark, folder).collect()
    times = {}
    for name in wanted:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(f"{times[name]:8.2f}  {name}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
