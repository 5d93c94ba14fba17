"""Headline queries at one scale: prints a single JSON line with seconds per query.

BENCH_SF_DIR names the folder of tables, BENCH_CPUS the local cores, BENCH_QUERIES an optional list of query names.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from clipline.plans.registry import QUERIES  # noqa: E402
from clipline.session import local_session  # noqa: E402

HEADLINE = (
    "select_clips transcript_windows score_segments rank_windows restore_punctuation candidate_duration dedupe_candidates"
    " remove_overlaps align_phrases snap_end word_exact_text candidate_text filter_and_score select_top_volume"
    " localize_words chunk_captions active_speaker_at label_slots merge_cuts energy_windows resample_track"
    " topic_tags latest_stage request_rate chunk_plan smooth_track cluster_scenes similarity_dedupe resolve_boundaries align_edits"
).split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "clipline-bench")
    spark.read.parquet(f"{folder}/region.parquet").count()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
