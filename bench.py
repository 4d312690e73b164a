"""Wall time of the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_ALL=1 for every registered query, BENCH_QUERIES for a comma-separated choice.
"""

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tiltmeter import registry  # noqa: E402

HEADLINE = [
    "standard_events", "usable_state_rows", "split_bundle", "stratified_sample", "few_shot_picks", "training_records",
    "dedup_keep_last", "overall_metrics", "core_table", "length_error_correlation", "harm_rates", "bias_significance",
    "fairness_table", "isotonic_maps", "threshold_sweep", "class_thresholds", "paired_correctness", "publication_table",
    "event_ambiguity", "top_disagreements", "annotated_events", "variants_control", "valid_variants",
    "flip_rates_by_tier", "differential_effect", "sensitivity_clusters", "word_impact", "rfc_rates", "attribution_deltas",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    every = registry.queries()
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else list(every) if os.environ.get("BENCH_ALL") else HEADLINE
    every["harm_rates"](spark, sf).write.format("noop").mode("overwrite").save()  # start the session before timing
    took = {}
    for name in names:
        t0 = time.time()
        every[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - t0, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec",
                      "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
