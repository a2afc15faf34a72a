"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the local cores. Every query's full result is consumed
by a ``noop`` sink; one warm-up query is run first so JVM start-up is not charged to the first entry.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pulsegrid.plans import catalogue  # noqa: E402
from pulsegrid.session import build_session  # noqa: E402

HEADLINE = [
    "group_summary", "left_join_meta", "crosstab_pivot", "median_impute", "quantiles", "dense_rank_dose", "systematic_sample",
    "rr_diff", "rhythm_summary", "hrv", "range_peak_match", "baseline_tiers", "window_sweep_best", "multi_width_recovery",
    "gap_interpolation", "beat_template", "beat_measures", "per_beat_qt", "feature_assembly", "qtc_family", "template_distance",
    "anova_f", "kruskal_h", "levene_w", "jonckheere_z", "spearman_rho", "effect_sizes", "zscore", "cov_matrix", "silhouette",
    "permanova_f", "permanova", "welch_psd", "mains_joint", "filter_variants", "lda_classification", "bootstrap_ci",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": str(max(8, int(cpus) if cpus.isdigit() else 8)), "spark.ui.enabled": "false",
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"), "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    catalogue.QUERIES["value_counts"](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        catalogue.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    scale = Path(folder).name.removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": float(scale) if scale.replace(".", "").isdigit() else scale}))


if __name__ == "__main__":
    main()
