"""Windows over a transcript: sliding windows, anchors grown to clean edges, ranking, compacting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import overlap
from ..functions.text import continues_thought, ends_sentence, reel_score
from ..functions.times import minutes_text
from ..session import cut_lineage_of
from .greedy import greedy_select
from .intervals import buckets, interval_join
from .ordered import block_if, lag, last_seen, position, row_block, running_sum, with_ordered
from .transcript import transcript_line

WINDOW_S = 900.0
OVERLAP_S = 180.0
MAX_WINDOWS = 64


def _stable_windows(width_s: float, overlap_s: float) -> tuple[float, float]:
    width = max(60.0, float(width_s))
    over = float(overlap_s)
    if over >= width:
        over = width * 0.2
    return width, width - max(0.0, over)


def last_end(segments: DataFrame) -> DataFrame:
    """End of the last segment of each video."""
    return segments.groupBy("video_id").agg(F.max_by("end_s", "seg_id").alias("total_s"))


def window_bounds(totals: DataFrame, width_s: float = WINDOW_S, overlap_s: float = OVERLAP_S) -> DataFrame:
    """Sliding windows of each video from its total length; the last one stops at the total."""
    width, step = _stable_windows(width_s, overlap_s)
    steps = F.when(F.col("total_s") <= width, F.lit(0)).otherwise(
        F.ceil((F.col("total_s") - width) / step).cast("int")
    )
    starts = totals.select("video_id", "total_s", F.explode(F.sequence(F.lit(0), steps)).alias("window"))
    return starts.select(
        "video_id",
        "window",
        (F.col("window") * F.lit(step)).alias("window_start"),
        F.least("total_s", F.col("window") * F.lit(step) + F.lit(width)).alias("window_end"),
    )


def transcript_windows(
    segments: DataFrame, width_s: float = WINDOW_S, overlap_s: float = OVERLAP_S
) -> DataFrame:
    """Every (window, segment) with the segment strictly overlapping the window.

    Windows sit on a regular grid, so a segment names its windows by arithmetic and no join on time is needed:
    only the total length of the video is joined, one row per video.
    """
    width, step = _stable_windows(width_s, overlap_s)
    rows = segments.join(last_end(segments), "video_id")
    single = F.col("total_s") <= width
    last = F.when(single, 0).otherwise(F.ceil((F.col("total_s") - width) / step))
    low = F.greatest(F.lit(0), F.floor((F.col("start_s") - width) / step))
    high = F.least(last, F.floor(F.col("end_s") / step))
    ids = F.when(single, F.array(F.lit(0).cast("bigint"))).otherwise(
        F.when(low <= high, F.sequence(low.cast("bigint"), high.cast("bigint")))
    )
    out = rows.withColumn("window", F.explode(ids)).withColumns({
        "window_start": F.col("window") * F.lit(step),
        "window_end": F.least(F.col("total_s"), F.col("window") * F.lit(step) + F.lit(width)),
    })
    inside = (F.col("end_s") > F.col("window_start")) & (F.col("start_s") < F.col("window_end"))
    return out.where((F.col("total_s") <= width) | inside).drop("total_s")


def score_segments(segments: DataFrame) -> DataFrame:
    return segments.withColumn("score", reel_score(F.col("text")))


def clean_walks(segments: DataFrame, reach: int = 8, large: bool | None = None) -> DataFrame:
    """Adds ``clean_start``: the nearest segment at or before this one that opens a thought.

    It does so when it does not lean on what came before and its predecessor closes a sentence. Without one
    among the last ``reach`` segments the walk stops ``reach`` segments back, or at the first.
    """
    block = block_if(large, segments, ["video_id"], row_block("seg_id"))
    flags = segments.withColumns({"__stop": ends_sentence(F.col("text")), "__lean": continues_thought(F.col("text"))})
    prev = with_ordered(flags, ["video_id"], ["seg_id"], {"__prev": lag(F.col("__stop"))}, block)
    clean = F.coalesce(~F.col("__lean") & F.col("__prev"), F.lit(False))
    marked = prev.withColumn("__clean", F.when(clean, F.col("seg_id")))
    seen = with_ordered(marked, ["video_id"], ["seg_id"], {"__at": last_seen(F.col("__clean"))}, block)
    near = F.when(F.col("__at") > F.col("seg_id") - reach, F.col("__at"))
    floor_ = F.greatest(F.lit(0), F.col("seg_id") - reach)
    return seen.withColumn("clean_start", F.coalesce(near, floor_)).drop("__prev", "__clean", "__at", "__stop", "__lean")


def clean_ends(
    starts: DataFrame, segments: DataFrame, desired_s: float, slack_s: float = 8.0, large: bool | None = None
) -> DataFrame:
    """For each start segment the first segment that ends long enough later on a sentence end.

    starts (video_id, start_idx, start_s); segments (video_id, seg_id, start_s, end_s, stop). Past
    ``desired_s + slack_s`` any segment will do; else the last. Both tests are joins on a bounded stretch of
    time, so a start never meets the rest of its video.
    """
    segs = segments.select(
        "video_id", F.col("seg_id").alias("end_idx"), F.col("end_s").alias("__end"),
        F.col("start_s").alias("__at"), F.col("stop").alias("__stop"),
    )
    block = block_if(large, segments, ["video_id"], row_block("end_idx"))
    # a segment serves limits in [end of its predecessor (or own start), own end]; a sentence end serves its own end
    runs = with_ordered(segs, ["video_id"], ["end_idx"], {"__prev": lag(F.col("__end"))}, block).withColumn(
        "__prev", F.least("__prev", "__at")
    )
    probe = starts.select("video_id", "start_idx", F.col("start_s").alias("__s0")).distinct().withColumns({
        "__lo": F.col("__s0") + desired_s, "__hi": F.col("__s0") + (desired_s + slack_s),
    })
    length = F.col("__end") - F.col("__s0")
    ends = (
        interval_join(probe, runs, ["video_id"], ("__lo", "__hi"), ("__prev", "__end"), closed=True)
        .where((F.col("end_idx") >= F.col("start_idx")) & ((length >= desired_s + slack_s) | (F.col("__stop") & (length >= desired_s))))
        .groupBy("video_id", "start_idx").agg(F.min("end_idx").alias("__first"))
    )
    final = segments.groupBy("video_id").agg(F.max("seg_id").alias("__last"))
    return (
        starts.join(ends, ["video_id", "start_idx"], "left")
        .join(final, "video_id")
        .withColumn("end_idx", F.coalesce("__first", "__last"))
        .drop("__first", "__last")
    )


def grown_windows(
    segments: DataFrame, desired_s: float, max_windows: int = MAX_WINDOWS, large: bool | None = None
) -> DataFrame:
    """Anchors grown to clean starts and ends, with their times and the order they are tried in.

    Scored segments are tried first (phase 0, best score and latest segment first), then evenly spaced coverage
    anchors (phase 1). The text is read once; what follows works on a slim table.
    """
    slim = clean_walks(segments, large=large).select(
        "video_id", "seg_id", "start_s", "end_s", "clean_start",
        reel_score(F.col("text")).alias("score"), ends_sentence(F.col("text")).alias("stop"),
    )
    slim = cut_lineage_of(slim, large)
    counts = slim.groupBy("video_id").agg(F.count("*").alias("__n"))
    step = F.greatest(F.lit(1), F.floor(F.col("__n") / max_windows))
    phases = F.filter(
        F.array(
            F.when(F.col("score") > -2, F.struct(F.lit(0).alias("phase"), F.col("score"))),
            F.when(F.col("seg_id") % step == 0, F.struct(F.lit(1).alias("phase"), (F.col("score") - 1).alias("score"))),
        ),
        lambda x: x.isNotNull(),
    )
    tried = slim.join(counts, "video_id").select(
        "video_id", "seg_id", F.col("clean_start").alias("start_idx"), F.inline(phases)
    )
    by_start = slim.select("video_id", F.col("seg_id").alias("start_idx"), "start_s")
    starts = slim.select("video_id", F.col("clean_start").alias("start_idx")).distinct().join(by_start, ["video_id", "start_idx"])
    by_end = slim.select("video_id", F.col("seg_id").alias("end_idx"), "end_s")
    spans = clean_ends(starts, slim, desired_s, large=large).join(by_end, ["video_id", "end_idx"])
    return tried.join(spans, ["video_id", "start_idx"]).withColumns({
        "__o1": F.when(F.col("phase") == 0, -F.col("score")).otherwise(F.lit(0.0)),
        "__o2": F.when(F.col("phase") == 0, -F.col("seg_id")).otherwise(F.col("seg_id")),
    })


def rank_windows(
    segments: DataFrame, desired_s: float = 55.0, max_windows: int = MAX_WINDOWS, large: bool | None = None
) -> DataFrame:
    """Up to ``max_windows`` windows per video, best anchors first, none sharing more than 45 % of ``desired_s``."""
    grown = cut_lineage_of(grown_windows(segments, desired_s, max_windows, large), large)
    limit = desired_s * 0.45
    kept = greedy_select(
        grown, ["video_id"], ["phase", "__o1", "__o2"], ["phase", "seg_id"], ["start_s", "end_s"],
        lambda k, x: overlap(k["start_s"], k["end_s"], x["start_s"], x["end_s"]) > limit,
        buckets(F.col("start_s"), F.col("end_s"), desired_s),
    )
    # the windows kept are at most duration / (0.55 * desired): the rank reads few rows
    ranked = with_ordered(kept, ["video_id"], ["phase", "__o1", "__o2"], {"__r": position()}).where(F.col("__r") < max_windows)
    return ranked.select("video_id", "start_idx", "end_idx", "start_s", "end_s", "score")


def compact_transcript(
    segments: DataFrame, budget: int = 42000, full_budget: int = 68000, desired_s: float = 55.0,
    max_windows: int = MAX_WINDOWS, large: bool | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(full, compact): lines of videos that fit ``full_budget`` characters, and window blocks of the others.

    A block is the header and the lines of a ranked window; blocks are taken in time order until one would pass
    ``budget``. The first is always taken.
    """
    speaker = F.col("speaker") if "speaker" in segments.columns else F.lit(None).cast("string")
    lined = segments.withColumn("line", transcript_line(F.col("start_s"), F.col("end_s"), speaker, F.col("text")))
    sizes = lined.groupBy("video_id").agg((F.sum(F.length("line") + 1) - 1).alias("full_chars"))
    full = lined.join(sizes.where(F.col("full_chars") <= full_budget), "video_id").select(
        "video_id", "seg_id", "line"
    )
    long_videos = sizes.where(F.col("full_chars") > full_budget).select("video_id")
    part = segments.join(long_videos, "video_id", "left_semi")
    wins = rank_windows(part, desired_s, max_windows, large)
    wins = with_ordered(wins, ["video_id"], ["start_s", "start_idx", "end_idx"], {"__r": position()})
    wins = wins.withColumnRenamed("__r", "rank").withColumn(
        "header",
        F.concat(
            F.format_string("[WINDOW %02d score=", F.col("rank") + 1), F.round("score", 1).cast("decimal(10,1)").cast("string"),
            F.lit(" "), minutes_text(F.col("start_s")), F.lit(" -> "), minutes_text(F.col("end_s")), F.lit("]"),
        ),
    )
    spans = wins.select("video_id", "rank", "header", F.explode(F.sequence("start_idx", "end_idx")).alias("seg_id"))
    body = spans.join(lined.select("video_id", "seg_id", "line"), ["video_id", "seg_id"])
    blocks = body.groupBy("video_id", "rank", "header").agg(
        F.concat_ws("\n", F.col("header"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seg_id", "line"))), lambda x: x["line"]), "\n")).alias("block")
    )
    sized = with_ordered(blocks, ["video_id"], ["rank"], {"__used": running_sum(F.length("block") + 2)})
    over = F.when((F.col("__used") > budget) & (F.col("rank") > 0), 1).otherwise(0)
    cut = with_ordered(sized.withColumn("__over", over), ["video_id"], ["rank"], {"__past": running_sum(F.col("__over"))})
    return full, cut.where("__past = 0").select("video_id", "rank", "block")


def fixed_slices(
    segments: DataFrame, min_s: float, max_s: float, limit: int | None, overlap_ratio: float = 0.2, shortest_s: float = 10.0
) -> DataFrame:
    """Evenly spaced fallback slices with the segments each covers; every score is 6. No ``limit``: all slices."""
    width = max(float(min_s), min(float(max_s), 60.0))
    step = width * (1 - overlap_ratio)
    totals = last_end(segments)
    n = F.ceil(F.col("total_s") / step)
    slots = totals.where(F.col("total_s") > 0).select(
        "video_id", "total_s", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(n - 1, F.lit(0)))).alias("slot")
    ).select(
        "video_id", "slot", (F.col("slot") * step).alias("slice_start"),
        F.least("total_s", F.col("slot") * step + width).alias("slice_end"),
    ).where(F.col("slice_end") - F.col("slice_start") >= shortest_s)
    hit = interval_join(
        slots, segments.select("video_id", "seg_id", "start_s", "end_s", "text"), ["video_id"],
        ("slice_start", "slice_end"), ("start_s", "end_s"), width,
    )
    slices = hit.groupBy("video_id", "slot", "slice_start", "slice_end").agg(
        F.sort_array(F.collect_list(F.struct("seg_id", "start_s", "end_s"))).alias("segments"),
        F.min_by("text", "seg_id").alias("__first"),
    )
    # one row per slice, a slice every step seconds: few rows per video
    numbered = with_ordered(slices, ["video_id"], ["slot"], {"__i": position()})
    scores = ("hook_score", "flow_score", "virality_score", "completeness_score", "boundary_score", "meaning_score")
    return (numbered if limit is None else numbered.where(F.col("__i") < limit)).select(
        "video_id",
        F.format_string("w01_c%02d", F.col("__i") + 1).alias("candidate_id"),
        F.concat(F.lit("Key Segment Part "), (F.col("__i") + 1).cast("string")).alias("title"),
        F.col("slice_start").alias("start_s"), F.col("slice_end").alias("end_s"),
        "segments", F.substring("__first", 1, 100).alias("hook_text"),
        *[F.lit(6.0).alias(s) for s in scores],
    )
