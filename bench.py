"""Headline timings: one JSON line with seconds per query (median of three warm runs)."""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from pyspark.sql import SparkSession

from greenlattice.plans import catalog

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
HEADLINE = [
    "climate_monthly", "climate_validated", "outliers_iqr", "species_metrics_sites", "species_metrics_grid",
    "radius_pairs", "points_within_regions", "nearest_site_per_occurrence", "landuse_overlap", "first_row_per_place",
    "scale_robust", "scale_groups_standard", "percentile_rank", "mutual_information", "engineered_features",
    "risk_target_by_category", "regression_metrics", "stratified_folds", "box_summary_by_status", "closed_form_heatmap",
]
#: Longer ones: a warm-up and one run.
LONG = ["nearest_row_imputation"]


def main() -> None:
    spark = (SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
             .config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "16g")
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in [*HEADLINE, *LONG]:
        times = []
        for run in range((1 if name in LONG else RUNS) + 1):
            begun = time.perf_counter()
            catalog.QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
            if run:  # the first run warms the code paths
                times.append(time.perf_counter() - begun)
        seconds[name] = round(statistics.median(times), 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(FOLDER.rstrip("/"))}))


if __name__ == "__main__":
    main()
