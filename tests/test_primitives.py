"""Primitives against plain loops on random small inputs."""

import random

import pytest
from pyspark.sql import functions as F

from clipline.operators import ordered as o
from clipline.operators.greedy import select_apart
from clipline.operators.intervals import asof_nearest, interval_join, islands, with_run_length


def spans(rng, videos=6, n=40, width=200.0):
    rows = []
    for v in range(videos):
        for i in range(rng.randrange(0, n)):
            s = round(rng.uniform(0, width), 1)
            rows.append((v, i, s, round(s + rng.choice([0.0, 0.5, 3.0, 20.0, 70.0]), 1), rng.randrange(5)))
    return rows


SPAN = "v long, i long, start_s double, end_s double, score long"


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_ordered_matches_loop(spark, size):
    rng = random.Random(size)
    rows = [(v, i, rng.choice([None, 1, 2, 5])) for v in range(4) for i in range(rng.randrange(1, 30))]
    df = spark.createDataFrame(rows, "v long, i long, x long")
    x = F.col("x")
    specs = {
        "prev": o.lag(x), "next": o.lead(x), "run": o.running_sum(x), "bef": o.sum_before(x),
        "mx": o.max_before(x), "last": o.last_seen(x), "nxt": o.next_seen(x), "pos": o.position(),
    }
    got = {(r.v, r.i): r for r in o.with_ordered(df, ["v"], ["i"], specs, o.row_block("i", size)).collect()}
    plain = {(r.v, r.i): r for r in o.with_ordered(df, ["v"], ["i"], specs).collect()}
    for v in range(4):
        xs = [r[2] for r in rows if r[0] == v]
        for i in range(len(xs)):
            before = [a for a in xs[:i] if a is not None]
            upto = [a for a in xs[: i + 1] if a is not None]
            after = [a for a in xs[i:] if a is not None]
            want = (
                xs[i - 1] if i else None, xs[i + 1] if i + 1 < len(xs) else None, sum(upto), sum(before),
                max(before) if before else None, upto[-1] if upto else None, after[0] if after else None, i,
            )
            for g in (got[v, i], plain[v, i]):
                assert (g.prev, g.next, g.run, g.bef, g.mx, g["last"], g.nxt, g.pos) == want


@pytest.mark.parametrize("bucket", [5.0, 60.0])
def test_interval_join_matches_nested_loop(spark, bucket):
    rows = spans(random.Random(3))
    a = spark.createDataFrame(rows, SPAN)
    b = a.select("v", F.col("i").alias("j"), F.col("start_s").alias("s2"), F.col("end_s").alias("e2"))
    got = sorted(tuple(r) for r in interval_join(a, b, ["v"], ("start_s", "end_s"), ("s2", "e2"), bucket).select("v", "i", "j").collect())
    want = sorted((p[0], p[1], q[1]) for p in rows for q in rows if p[0] == q[0] and p[2] < q[3] and q[2] < p[3])
    assert got == want


@pytest.mark.parametrize("gap,strict", [(0.0, True), (0.0, False), (0.5, False)])
def test_islands_match_loop(spark, gap, strict):
    rows = spans(random.Random(7))
    df = spark.createDataFrame(rows, SPAN)
    got = islands(df, ["v"], ["start_s", "end_s", "i"], gap_s=gap, strict=strict, block=o.time_block("start_s", 20.0))
    got = sorted((r.v, r.start_s, r.end_s, r.n_parts) for r in got.collect())
    want = []
    for v in sorted({r[0] for r in rows}):
        runs = []
        for s, e in sorted((r[2], r[3]) for r in rows if r[0] == v):
            joins = runs and (s < runs[-1][1] + gap if strict else s <= runs[-1][1] + gap)
            if joins:
                runs[-1] = [runs[-1][0], max(runs[-1][1], e), runs[-1][2] + 1]
            else:
                runs.append([s, e, 1])
        want += [(v, *r) for r in runs]
    assert got == sorted(want)


def clash(k, x):
    shared = F.least(k["end_s"], x["end_s"]) - F.greatest(k["start_s"], x["start_s"])
    shorter = F.greatest(F.lit(0.1), F.least(k["end_s"] - k["start_s"], x["end_s"] - x["start_s"]))
    return (shared > 0) & (shared / shorter > 0.5)


@pytest.mark.parametrize("small", [1, 4, 5000])
def test_greedy_matches_loop(spark, small):
    rows = spans(random.Random(11), videos=4)
    df = spark.createDataFrame(rows, SPAN).withColumn("worst", -F.col("score"))
    got = select_apart(df, ["v"], ["worst"], ["i"], clash, cell_s=15.0, small_group=small)
    got = sorted((r.v, r.i) for r in got.collect())
    want = []
    for v in range(4):
        kept = []
        for r in sorted((r for r in rows if r[0] == v), key=lambda r: (-r[4], r[1])):
            bad = False
            for k in kept:
                shared = min(k[3], r[3]) - max(k[2], r[2])
                shorter = max(0.1, min(k[3] - k[2], r[3] - r[2]))
                bad |= shared > 0 and shared / shorter > 0.5
            if not bad:
                kept.append(r)
        want += [(v, k[1]) for k in kept]
    assert got == sorted(want)


def test_nearest_and_run_length(spark):
    rng = random.Random(5)
    pts = [(v, i, round(rng.uniform(0, 50), 1)) for v in range(3) for i in range(20)]
    tgt = [(v, i, round(rng.uniform(0, 50), 1)) for v in range(2) for i in range(15)]
    p = spark.createDataFrame(pts, "v long, i long, t double")
    g = spark.createDataFrame(tgt, "v long, j long, at double")
    got = {(r.v, r.i): r.j for r in asof_nearest(p, g, ["v"], "t", "at", ["j"], ["i"], block_s=7.0).collect()}
    for v, i, t in pts:
        mine = [x for x in tgt if x[0] == v]
        want = min(mine, key=lambda x: (abs(x[2] - t), x[2], x[1]))[1] if mine else None
        if want is None:
            assert got[v, i] is None
        else:
            hit = [x for x in mine if x[1] == got[v, i]][0]
            assert abs(abs(hit[2] - t) - min(abs(x[2] - t) for x in mine)) < 1e-9
    flags = [(1, i, rng.random() < 0.6) for i in range(40)]
    runs = with_run_length(spark.createDataFrame(flags, "v long, i long, f boolean"), ["v"], "i", F.col("f"), "n", o.row_block("i", 7))
    got = {r.i: r.n for r in runs.collect()}
    n = 0
    for _, i, f in flags:
        n = n + 1 if f else 0
        assert got[i] == n
