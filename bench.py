"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the local cores and
``BENCH_QUERIES`` an optional comma-separated choice (``all`` for every query).
Every result row is computed and discarded.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lumenframe.plans.catalog import QUERIES  # noqa: E402
from lumenframe.session import local_session  # noqa: E402

HEADLINE = [
    "S1_csv_scan", "P1_dataset_info", "P2_numeric_describe", "P3_text_describe", "P5_high_correlations",
    "P6_column_roles", "P8_duplicate_rows", "P10_missingness_matrix", "C2_impute_median", "C4_forward_fill",
    "C7_outlier_summary_iqr", "C9_label_encode", "C11_scale_standard", "F1_derived_column", "F2_polynomial",
    "A1_mean", "A1_median", "A5_crosstab", "A7_stacked_values", "A8_pareto_counts", "A9_waterfall", "A10_slope",
    "D1_histogram", "D2_kde", "D4_box", "D7_ecdf", "D8_qq_fit", "D9_hexbin", "D12_before_after",
    "T3_line_by_group", "T4_resample_daily_mean", "T6_area", "T7_rolling_mean", "T7_rolling_events",
    "H1_pearson", "H2_spearman", "H3_kendall", "H4_shapiro", "H5_t_test", "H6_anova", "H7_chi_square",
    "M8_M9_roc_pr_summary", "M10_calibration", "M5_evaluate_regressor",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = HEADLINE if not chosen else list(QUERIES) if chosen == "all" else chosen.split(",")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    # Load classes and compile once before the clock starts.
    for warm in ("A1_mean", "C2_impute_median"):
        QUERIES[warm](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
