"""Loudness windows and the track catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import clamp, overlap, round_to
from .greedy import select_apart

# Lengths, thresholds, and the titles that are never picked.
LENGTHS_S = (8.0, 12.0, 16.0, 20.0, 24.0)
CELL_STARTS = 240  # window starts that one group of samples serves
INTRO_SKIP_S = 10.0
OUTRO_SKIP_S = 10.0
MIN_TRACK_S, MAX_TRACK_S = 60, 480
MIN_VIEWS = 300_000
BLOCKED_WORDS = (
    "hindi", "punjabi", "bollywood", "marathi", "bhojpuri", "tamil", "telugu",
    "kannada", "gujarati", "haryanvi", "desi", "mashup", "jukebox",
    "nepali", "nepal", "pakistani", "flute", "shehnai", "sitar", "tabla",
    "carnatic", "children", "kids", "nursery",
)
NON_LATIN = (
    r"[؀-ۿऀ-ॿঀ-৿਀-੿଀-୿஀-௿ఀ-౿ಀ-೿"
    r"぀-ヿ一-鿿가-힯]"
)


def energy_windows(
    loudness: DataFrame, tracks: DataFrame, intro_s: float = INTRO_SKIP_S, outro_s: float = OUTRO_SKIP_S
) -> DataFrame:
    """Rising or sustained stretches of a track with their score.

    loudness (track_id, t_s, lufs), tracks (track_id, duration_s). Windows start every second of the safe zone in
    five lengths. Samples are dealt out by track and stretch of ``CELL_STARTS`` window starts; only there does a sample
    name the windows it lies in, so what is shuffled are samples, never windows.
    """
    end = F.greatest(F.lit(0.0), F.col("duration_s") - outro_s)
    usable = end > intro_s + 8.0
    zone = tracks.select(
        "track_id", F.when(usable, F.lit(float(intro_s))).otherwise(F.lit(0.0)).alias("__a"), F.when(usable, end).otherwise(F.col("duration_s")).alias("__z")
    ).withColumn("__n", F.ceil(F.col("__z") - 8.0 - F.col("__a")).cast("bigint"))
    into = F.col("t_s") - F.col("__a")
    samples = loudness.select("track_id", "t_s", "lufs").join(zone.where("__n > 0"), "track_id").withColumns({
        "__lo": F.greatest(F.lit(0), F.floor(into - max(LENGTHS_S))).cast("bigint"), "__hi": F.least(F.col("__n") - 1, F.floor(into) + 1).cast("bigint"),
    }).where("__lo <= __hi").drop("__n")
    cell = lambda k: F.floor(k / CELL_STARTS)
    dealt = samples.withColumn("__cell", F.explode(F.sequence(cell(F.col("__lo")), cell(F.col("__hi")))))
    # few bytes that become many rows: a fixed number of tasks, else they would be put together by size
    # and samples in order of time, so that the means of a window do not change with the layout of the input
    tasks = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(tasks, "track_id", "__cell").sortWithinPartitions("track_id", "__cell", "t_s", "lufs")
    first = F.greatest(F.col("__lo"), F.col("__cell") * CELL_STARTS)
    last = F.least(F.col("__hi"), (F.col("__cell") + 1) * CELL_STARTS - 1)
    hit = (
        dealt.withColumn("__k", F.explode(F.sequence(first, last))).withColumn("w_start", F.col("__a") + F.col("__k")).where("w_start <= t_s")
        .withColumn("length_s", F.explode(F.array(*[F.lit(x) for x in LENGTHS_S])))
        .withColumn("w_end", F.col("w_start") + F.col("length_s")).where("t_s <= w_end and w_end <= __z")
    )
    early = F.col("t_s") <= F.col("w_start") + F.col("length_s") * 0.2
    late = F.col("t_s") >= F.col("w_start") + F.col("length_s") * 0.8
    silent = F.lit(-120.0)
    stats = hit.groupBy("track_id", "__cell", "w_start", "w_end", "length_s").agg(
        F.coalesce(F.avg(F.when(early, F.col("lufs"))), silent).alias("__first"),
        F.coalesce(F.avg(F.when(late, F.col("lufs"))), silent).alias("__last"),
        F.avg("lufs").alias("avg_vol"), F.max("lufs").alias("peak_vol"),
    ).where("peak_vol >= -40.0")
    rise = (F.col("__last") > F.col("__first") + 3.0) & (F.col("peak_vol") > -25.0)
    rise_score = (F.col("__last") - F.col("__first")) * F.col("length_s") * (1.0 + (F.col("peak_vol") + 20.0) / 100.0)
    hold_score = (100.0 + F.col("avg_vol")) * (F.col("length_s") / 10.0)
    return stats.withColumn("kind", F.when(rise, "rise").when(F.col("avg_vol") > -22.0, "sustain")).where("kind is not null").select(
        "track_id", F.col("w_start").alias("start_s"), F.col("w_end").alias("end_s"), "kind",
        round_to(F.when(rise, rise_score).otherwise(hold_score), 2).alias("score"), "peak_vol", "avg_vol",
    )


def distinct_windows(windows: DataFrame, ratio: float = 0.5, small_group: int = 5000, large: bool | None = None) -> DataFrame:
    """Drop a window that shares more than ``ratio`` of the shorter with a better kept one."""

    def conflict(k, x):
        shared = overlap(k["start_s"], k["end_s"], x["start_s"], x["end_s"])
        return (shared > 0) & (shared / F.least(k["end_s"] - k["start_s"], x["end_s"] - x["start_s"]) > ratio)

    ranked = windows.withColumn("__worst", -F.col("score"))
    return select_apart(
        ranked, ["track_id"], ["__worst", "start_s", "end_s"], ["start_s", "end_s"], conflict, cell_s=24.0, small_group=small_group, large=large
    ).drop("__worst")


def _share(seed: int, *cols: str) -> Column:
    """A fraction in [0, 1) that depends on the row alone, so a retried task gives the same one."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1_000_000)) / 1_000_000.0


def assign_windows(clips: DataFrame, windows: DataFrame, tracks: DataFrame, seed: int = 0) -> DataFrame:
    """A track offset for each clip (track_id, clip_no, duration_s): each window once, rises first, then rises again.

    A rise ends ``min(12, 0.4 * length)`` into the clip. Tracks under twice the clip or without windows get any
    offset. The order among equals comes from a hash of the row and the seed.
    """
    order = Window.partitionBy("track_id").orderBy(F.when(F.col("kind") == "rise", 0).otherwise(1), F.xxhash64(F.lit(seed), "start_s", "end_s"), "start_s", "end_s")
    ranked = windows.withColumn("__w", F.row_number().over(order) - 1)
    counts = windows.groupBy("track_id").agg(F.count("*").alias("__n"), F.count_if(F.col("kind") == "rise").alias("__rises"))
    place = Window.partitionBy("track_id").orderBy("clip_no")
    base = (
        clips.withColumn("__i", F.row_number().over(place) - 1)
        .join(counts, "track_id", "left").join(tracks.select("track_id", F.col("duration_s").alias("__dur")), "track_id")
    )
    pool = F.when(F.col("__rises") > 0, F.col("__rises")).otherwise(F.col("__n"))
    pick = F.when(F.col("__i") < F.col("__n"), F.col("__i")).otherwise(F.pmod(F.col("__i") - F.col("__n"), pool))
    free = F.col("__n").isNull() | (F.col("__dur") < F.col("duration_s") * 2)
    base = base.withColumn("__w", F.when(~free, pick))
    hit = base.join(ranked.select("track_id", "__w", "start_s", "end_s", "kind"), ["track_id", "__w"], "left")
    room = F.greatest(F.lit(0.0), F.col("__dur") - F.col("duration_s"))
    share = _share(seed, "track_id", "clip_no")
    hold_to = F.greatest("start_s", F.col("end_s") - F.col("duration_s"))
    offset = (
        F.when(F.col("kind").isNull(), room * share)
        .when(F.col("kind") == "rise", F.col("end_s") - F.least(F.lit(12.0), F.col("duration_s") * 0.4))
        .otherwise(F.col("start_s") + (hold_to - F.col("start_s")) * share)
    )
    return hit.select("track_id", "clip_no", "kind", clamp(offset, 0.0, room).alias("offset_s"))


def assign_tracks(clips: DataFrame, tracks: DataFrame, mode: str = "roundrobin", seed: int = 0) -> DataFrame:
    """A track per clip (video_id, clip_no): ``same``, ``roundrobin``, or ``random`` never twice in a row.

    tracks (video_id, track_no from 0, track_id): the few tracks on offer for the clips of a video.
    """
    n = tracks.groupBy("video_id").agg(F.count("*").alias("__n"))
    place = Window.partitionBy("video_id").orderBy("clip_no")
    base = clips.join(n, "video_id").withColumn("__i", F.row_number().over(place) - 1)
    if mode == "same":
        pick = F.lit(0)
    elif mode == "roundrobin":
        pick = F.pmod(F.col("__i"), F.col("__n"))
    else:
        # steps of 1 .. n-1 from the track before never repeat it
        step = F.when(F.col("__i") == 0, F.floor(_share(seed, "video_id", "clip_no") * F.col("__n"))).otherwise(
            1 + F.floor(_share(seed, "video_id", "clip_no") * (F.col("__n") - 1))
        )
        pick = F.pmod(F.sum(step).over(place), F.col("__n"))
    return base.withColumn("track_no", pick.cast("bigint")).join(tracks, ["video_id", "track_no"]).select("video_id", "clip_no", "track_id")


def title_key(title: Column) -> Column:
    """First four words: uploads of the same song share it."""
    return F.array_join(F.slice(F.regexp_extract_all(F.lower(title), F.lit(r"[a-z0-9]+"), F.lit(0)), 1, 4), " ")


def pick_tracks(catalog: DataFrame, n: int, seen: DataFrame | None = None) -> DataFrame:
    """The ``n`` most viewed tracks of fitting length, one per title key, that were not taken before.

    One row per key comes from a map-side combined maximum; the top n never needs a full sort.
    """
    low = F.lower("title")
    blocked = F.lit(False)
    for w in BLOCKED_WORDS:
        blocked = blocked | low.contains(w)
    length = F.coalesce("duration", F.lit(0))
    fit = catalog.where(
        ((length == 0) | length.between(MIN_TRACK_S, MAX_TRACK_S))
        & ~F.coalesce("live_status", F.lit("")).isin("is_live", "is_upcoming")
        & ~F.col("title").rlike(NON_LATIN) & ~blocked & (F.coalesce("view_count", F.lit(0)) >= MIN_VIEWS)
    )
    if seen is not None:
        fit = fit.join(seen.select("track_id").distinct(), "track_id", "left_anti")
    best = fit.groupBy(title_key(F.col("title")).alias("title_key")).agg(
        F.max_by(F.struct("track_id", "title", "view_count"), F.struct("view_count", (-F.col("track_id")).alias("o"))).alias("__b")
    )
    return best.select("title_key", "__b.*").orderBy(F.col("view_count").desc(), "track_id").limit(n)
