"""Nearest hashes and phrase search with heavy tokens, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from clipline.operators import align, hashes, scenes


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def distance(a, b):
    return ((a ^ b) & ((1 << 64) - 1)).bit_count()


def near_to(rng, h, bits):
    for b in rng.sample(range(64), bits):
        h ^= 1 << b
    return h


@pytest.mark.parametrize("block", [1024, 5])
def test_nearest_hashes(spark, block):
    """Every distance from 0 to far, ties, copies, one hot key, NULLs and keys on one side only."""
    rng = random.Random(3)
    targets, probes = [], []
    for v, n in ((0, 120), (1, 6), (2, 1)):
        own = [rng.getrandbits(64) for _ in range(n)]
        targets += [(v, signed(h), i, 1000 * v + i) for i, h in enumerate(own)] + [(v, signed(own[0]), n + 5, 77), (v, None, -1, 78)]
        probes += [(v, signed(near_to(rng, rng.choice(own), rng.randrange(13)))) for _ in range(4 * n)] + [(v, signed(rng.getrandbits(64))) for _ in range(20)]
    probes += [(0, 0), (0, -1), (0, None), (9, 5)] + probes[:30]
    targets += [(8, 5, 0, 1)]
    df = lambda rows, schema: spark.createDataFrame(rows, schema).repartition(5)
    out = hashes.nearest_hashes(df(probes, "video_id int, phash long"), df(targets, "video_id int, phash long, ord int, id int"), ["video_id"], block)
    got = sorted(tuple(r) for r in out.select("video_id", "phash", "id", "distance").collect())
    want = []
    for v, p in {x for x in probes if x[1] is not None}:
        mine = [(distance(p, h), o, i) for w, h, o, i in targets if w == v and h is not None]
        if mine:
            d, _, i = min(mine)
            want.append((v, p, i, d))
    assert got == sorted(want)


def test_band_keys_promise(spark):
    """Hashes within 4 f + 3 bits share a band key."""
    rng = random.Random(4)
    rows = []
    for bits in range(8):
        for _ in range(40):
            h = rng.getrandbits(64)
            rows.append((signed(h), signed(near_to(rng, h, bits)), bits))
    df = spark.createDataFrame(rows, "a long, b long, bits int")
    met = df.withColumn("m", F.when(F.col("bits") <= 3, F.arrays_overlap(hashes.band_keys(F.col("a")), hashes.band_keys(F.col("b")))).otherwise(
        F.arrays_overlap(hashes.band_keys(F.col("a"), 1), hashes.band_keys(F.col("b")))))
    assert met.where(~F.col("m")).count() == 0


def test_remap_scenes_cases(spark):
    templates = spark.createDataFrame([(1, 0, 0), (1, 1, 3), (1, 2, None), (1, 3, 255), (2, 0, 1), (3, 0, None), (3, 1, None)], "video_id int, template_id int, phash long")
    active = spark.createDataFrame([(1, 1, 5), (1, 3, 2), (3, 1, 0), (1, 9, 8)], "video_id int, template_id int, ord int")
    assigned = spark.createDataFrame([(1, 10, 0), (1, 11, 1), (1, 12, 2), (1, 13, 50), (1, 14, 9), (2, 20, 0), (3, 30, 0), (1, 15, None)], "video_id int, scene int, template_id int")
    got = {(r.video_id, r.scene): r.template_id for r in scenes.remap_scenes(assigned, templates, active).collect()}
    assert got == {(1, 10): 1, (1, 11): 1, (1, 12): 3, (1, 13): 3, (1, 14): 9, (2, 20): 0, (3, 30): 1, (1, 15): 3}


@pytest.mark.parametrize("on", [[], ["video_id"]])
def test_phrases_of_heavy_tokens(spark, on):
    """One token is nine words in ten; phrases of it alone are found at every place, each once."""
    rng = random.Random(6)
    words = []
    for v in range(3):
        words += [(v, i, "the" if rng.random() < 0.9 else rng.choice("abcdef")) for i in range(400)]
    phrases = ["the the the", "the a the b", "the", "c", "zzz the the the", "", "f f"]
    anchors = [(v, 10 * v + i, p) for v in range(3) for i, p in enumerate(phrases)] if on else [(i, p) for i, p in enumerate(phrases)]
    a = spark.createDataFrame(anchors, ("video_id int, " if on else "") + "anchor_id int, phrase string")
    w = spark.createDataFrame(words, "video_id int, word_idx int, clean string").repartition(6)
    got = sorted((r.video_id, r.anchor_id, r.start_idx, round(r.ratio, 6)) for r in align.phrase_matches(a, w, on).collect())
    want = []
    for v in range(3):
        mine = [x[2] for x in words if x[0] == v]
        for row in anchors:
            if on and row[0] != v:
                continue
            toks = row[-1].split()
            for s in range(len(mine) - len(toks) + 1):
                if toks:
                    r = sum(x == y for x, y in zip(toks, mine[s:])) / len(toks)
                    if r >= 0.7:
                        want.append((v, row[-2], s, round(r, 6)))
    assert got == sorted(want)


def test_word_shares_are_bounded(spark):
    freq = spark.createDataFrame([("the", 900), ("a", 60), ("b", 39), ("c", 1)], "clean string, __f long")
    assert {r.clean: r["__salts"] for r in align.word_shares(freq, 10).collect()} == {"the": 9}
    many = spark.range(1000).select(F.col("id").cast("string").alias("clean"), (F.col("id") + 1).alias("__f"))
    found = align.word_shares(many, 16)
    assert found.count() <= 16
    assert align.word_shares(freq.limit(0)).count() == 0
