"""Runs the headline queries once each and prints one line of JSON."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from changeloom.plans import registry

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINES = [
    "a2_changesets_by_author", "a1_collect_by_key", "w1_classify_file_history", "w2_tree_intervals", "j1_detect_renames", "j1_to_j4_resolve_copies", "j6_snapshot_diff", "j7_align_with_tree",
    "j10_find_applied", "j11_place_tags", "d2_directory_changes", "d3_detect_dir_renames", "e1_fold_patch_entries", "o2_topo_order", "s1_log_to_changesets", "s2_patchset_log", "s3_xml_log", "s4_patch_xml", "s6_commit_raw", "f6_refill",
]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = registry.queries(), {}
    for name in ("w1_classify_file_history", "f6_refill"):  # start-up of Spark and of Python workers is not timed
        queries[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    for name in HEADLINES:
        began = time.time()
        queries[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/"))}))


if __name__ == "__main__":
    main()
