"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (table folder), BENCH_CPUS (local cores), BENCH_QUERIES (comma
list) choose what is run.  Results go to the noop sink, so every row is
computed and none is collected.
"""

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lading.queries import QUERIES  # noqa: E402

HEADLINE = (
    "classify_pages manifest_index presence_checksum resume_plan unexpected_files "
    "event_seq double_verdicts file_states sessions failure_trip session_status "
    "transfer_counters delivery_report unify_names stem_runs shared_names "
    "structure_variants unify_columns schema_codes schema_conform spec_runs_of_orders "
    "repeated_schema meta_check flatten_props validate_orders_as_hdus parse_bytes "
    "crc_index lint_objects lint_report stream_file_states"
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", HEADLINE.replace(" ", ",")).split(",")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lading-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["failure_texts"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr)
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
