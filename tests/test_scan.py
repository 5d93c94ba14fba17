"""State along ordered rows against plain loops, over many blocks, and on one key with very many rows."""

import random

import pytest
from pyspark.sql import functions as F

from clipline.operators import captions, ordered, scan, scenes, tracks


def test_follow(spark):
    rng = random.Random(3)
    links, starts, want = [], [], set()
    for v in range(6):
        jump = {i: i + rng.randint(1, 4) for i in range(200)}
        links += [(v, i, j) for i, j in jump.items()]
        at = rng.randint(0, 5)
        starts.append((v, at))
        while True:
            want.add((v, at))
            if at not in jump:
                break
            at = jump[at]
    got = scan.follow(spark.createDataFrame(starts, "v long, at long"), spark.createDataFrame(links, "v long, at long, next long"), ["v"])
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


@pytest.mark.parametrize("alpha", [0.35, 0.98, 1.0, 0.0004])
def test_decaying_means_over_blocks(spark, alpha):
    rng = random.Random(1)
    values = [rng.uniform(-5, 50) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(values)), "t long, x double").withColumn("k", F.lit(1))
    got = {r.t: r.x for r in scan.decaying_means(df, ["k"], ["t"], ["x"], alpha, ordered.row_block("t", 700)).collect()}
    mean = None
    for t, x in enumerate(values):
        mean = x if mean is None else alpha * x + (1 - alpha) * mean
        assert abs(got[t] - mean) < 1e-9 * max(1, abs(mean))


def test_two_million_words_in_one_clip(spark):
    """Pairs of short words with a long one in between: the parity runs over every block."""
    n = 2_000_000
    words = spark.range(n).select(
        F.lit(1).alias("video_id"), F.lit("c").alias("clip_name"), F.col("id").cast("int").alias("word_idx"),
        F.when(F.col("id") % 1001 == 1000, "extraordinarily").otherwise("go").alias("word"), (F.col("id") * 0.5).alias("start_s"), (F.col("id") * 0.5 + 0.3).alias("end_s"),
    )
    got = captions.chunk_captions(words).agg(F.count("*").alias("n"), F.count_if(F.col("line2") != "").alias("pairs"), F.max("caption_no").alias("last")).first()
    runs, rest = divmod(n, 1001)
    # 1000 words that may pair: 999 with a short one after them, the last one stands alone beside the long one
    want = sum(1 for _ in range(runs)) * (500 + 1) + -(-rest // 2)
    assert (got.n, got.last) == (want, want) and got.pairs == runs * 500 + rest // 2


def test_one_long_run_of_cuts(spark):
    cuts = spark.range(60_000).select(F.lit(1).alias("video_id"), F.lit("a").alias("detector"), (F.col("id") * 0.1).alias("t_s"))
    times = sorted(r.t_s for r in cuts.collect())
    kept = []
    for t in times:
        if not kept or t - kept[-1] > 0.35:
            kept.append(t)
    assert sorted(r.t_s for r in scenes.merge_cuts(cuts).collect()) == kept


def test_dwell_over_blocks(spark):
    rng = random.Random(9)
    rows, who = [], "a"
    for i in range(4000):
        who = rng.choice(["a", "b", "UNKNOWN", None]) if rng.random() < 0.2 else who
        rows.append((1, 0, i * 0.4, who))
    frame = spark.createDataFrame(rows, "video_id long, seg_index int, t_s double, speaker string")
    got = {r.t_s: r.committed for large in (None, False) for r in tracks.dwell_gate(frame, large=large).collect()}
    now, candidate, since = None, None, 0.0
    for _, _, t, who in rows:
        now = (who or "UNKNOWN") if now is None else now
        who = now if who in (None, "UNKNOWN") else who
        if who != now:
            if who != candidate:
                candidate, since = who, t
            if t - since >= tracks.DWELL_S:
                now, candidate = who, None
        else:
            candidate = None
        assert got[t] == now
