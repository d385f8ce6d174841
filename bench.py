"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the number of local cores, BENCH_QUERIES (comma
separated) another choice of queries, "all" for every registered one.
"""

from __future__ import annotations

import json
import os
import time

from trapline.plans import catalogue
from trapline.session import clear_scratch, local_session

HEADLINES = [
    "win1_sequence_summary",
    "win1_sequences_per_locality",
    "win1_sequences_whole_frame",
    "set1_content_dedup",
    "str5_path_structure",
    "dt2_capture_time",
    "flt10_missing_taxon",
    "agg2_user_dashboard",
    "agg7_archive_statistics",
    "set8_metadata_import",
    "win10_video_key_frame",
    "top_4_best_representatives",
    "jn11_similar_identities",
    "jn12_names_in_filenames",
    "sim3_top_shortlist",
    "sim11_top_identities",
    "post4_detector_fallback",
    "spl2_split_ratio",
    "set6_identity_merge",
    "sim17_sequence_clusters",
    "agg21_mean_vector_per_group",
    "jn7_nearest_area",
    "top_2_page",
    "stm2_online_sequences",
]


def run(name: str, spark, folder: str) -> float:
    start = time.perf_counter()
    catalogue.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(catalogue.QUERIES) if chosen == "all" else [n for n in chosen.split(",") if n] or HEADLINES
    spark = local_session("bench", cores, partitions=max(int(cores), 1) if cores != "*" else 8)
    run(HEADLINES[0], spark, folder)  # start the JVM's threads and the code generator
    seconds = {name: round(run(name, spark, folder), 3) for name in names}
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": folder.rstrip("/").split("sf")[-1]}))
    clear_scratch(spark)
    spark.stop()


if __name__ == "__main__":
    main()
