"""Times the headline queries: prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from muxlake import catalog

HEADLINES = ["pid_histogram", "cc_check", "pcr_interpolate", "pcr_gap_stats", "buffering_report", "dts_monotonic", "max_rate_window", "pid_stream_type_left_join", "frame_size_by_type", "nal_histogram_grouping_sets", "gop_stats", "dots_string", "capture_stream_stats", "drift_per_section", "jitter_window", "packet_round_trip", "start_code_units"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/events.parquet").count()
    took = {}
    for name in HEADLINES:
        began = time.time()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
