"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "a1_plan_summary", "a1_plan_summary_light", "g2_segment_exact", "g2_segment_light", "g3_lossless", "g6_replace_terms",
    "t15_clean_documents", "t15_clean_pages", "t7_strip_source_header", "t11_url_audit", "t12_drop_matching_lines", "t17_audit_preview",
    "c1_split_chapters", "c5_epub_assemble", "c12_chapter_index", "i4_segment_id", "i5_occurrences", "i10_classify_segments",
    "i11_reuse_cache", "i12_latest_state", "q1_cer", "q6_longest_silence", "q8_check_clips", "b1_plan_batches", "b3_batch_identity",
    "b8_score_batches", "a2_progress_metrics", "a3_state_summary", "a8_book_status", "w3_queue_position", "w7_first_k_list",
    "j2_download_selection", "snk2_write_manifest", "convert_run", "st2_stream_latest_state", "st2_stream_latest_store", "st4_stream_progress",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    from lectern.plans import QUERIES
    from lectern.session import local_session

    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8, app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["a1_plan_summary"](spark, folder).collect()  # untimed: starts Python workers and warms the JVM
    wanted = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in wanted:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    result = {"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
              "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}
    if "g2_segment_exact" in seconds:
        chars = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("sum(length(text))").first()[0]
        result["segment_exact_chars_per_second"] = round(chars / seconds["g2_segment_exact"])
    print(json.dumps(result))


if __name__ == "__main__":
    main()
