"""Plans and partitioning: no nested loops or single-partition windows, same results however rows are spread."""

import random

import pytest
from pyspark.sql import functions as F

from clipline.operators import candidates, speakers, windows
from clipline.operators.intervals import interval_join
from clipline.operators.selection import select_top
from clipline.plans import registry

FOLDER = "/root/testdata/sf0.001"
CHEAP = (
    "transcript_windows score_segments clean_walks candidate_duration master_score select_top short_with_neighbours active_speaker_at"
    " slice_timeline merge_cuts scene_of refine_cut localize_words energy_windows resample_track latest_stage stale_stages request_rate log_tail"
).split()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", CHEAP)
def test_no_nested_loops(spark, name):
    text = plan_of(registry.QUERIES[name](spark, FOLDER))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "SinglePartition"):
        assert bad not in text, (name, bad)


def test_every_oracle_has_a_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES)


def test_top_n_is_cut_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("video_id"), F.col("id").alias("ord"), F.rand(1).alias("master_score"))
    assert "WindowGroupLimit" in plan_of(select_top(df, 3))


@pytest.mark.parametrize("partitions", ["1", "7", "64"])
def test_partition_invariance(spark, partitions):
    rng = random.Random(1)
    rows = [(rng.randrange(4), i, round(rng.uniform(0, 300), 2), rng.randrange(9)) for i in range(200)]
    rng.shuffle(rows)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.createDataFrame(rows, "video_id long, candidate_id long, start_s double, score long").withColumn("end_s", F.col("start_s") + 20.0)
        kept = sorted(r.candidate_id for r in candidates.dedupe_candidates(df, ["video_id"], "score", ["candidate_id"]).collect())
        total = {r.video_id: round(r.duration_s, 6) for r in candidates.span_durations(df, ["video_id"], ["start_s", "end_s", "candidate_id"], large=True).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    if not hasattr(test_partition_invariance, "want"):
        test_partition_invariance.want = (kept, total)
    assert (kept, total) == test_partition_invariance.want


def test_hot_video_equals_plain(spark):
    """One video with most rows gives the same through blocks as through plain windows."""
    rng = random.Random(3)
    rows = [(0 if i % 3 else 1, i, round(rng.uniform(0, 20000), 1)) for i in range(600)]
    turns = spark.createDataFrame([(v, s, s + 15.0, f"s{i % 4}") for v, i, s in rows], "video_id long, start_s double, end_s double, speaker string")
    points = spark.createDataFrame([(v, i, s + 7.3) for v, i, s in rows], "video_id long, point_id long, t_s double")
    a = sorted(tuple(r) for r in speakers.active_speaker_at(points, turns, large=True).select("video_id", "point_id", "speaker").collect())
    b = sorted(tuple(r) for r in speakers.active_speaker_at(points, turns, large=False).select("video_id", "point_id", "speaker").collect())
    assert a == b


def test_windows_cover_every_overlap(spark):
    rng = random.Random(9)
    rows, t = [], 0.0
    for i in range(80):
        e = t + rng.uniform(1, 30)
        rows.append((1, i, t, e, "x"))
        t = e
    segs = spark.createDataFrame(rows, "video_id long, seg_id int, start_s double, end_s double, text string")
    got = {(r.window, r.seg_id) for r in windows.transcript_windows(segs, 100.0, 30.0).collect()}
    total, k, start, want = rows[-1][3], 0, 0.0, set()
    while start < total:
        end = min(total, start + 100.0)
        want |= {(k, r[1]) for r in rows if r[3] > start and r[2] < end}
        if end >= total:
            break
        start, k = start + 70.0, k + 1
    assert got == want


def test_interval_join_needs_distinct_names(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0)], "v long, s double, e double")
    with pytest.raises(ValueError):
        interval_join(df, df, ["v"], ("s", "e"), ("s", "e"))
