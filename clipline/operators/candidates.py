"""Scored candidate spans: normalise, measure, score, extend, de-duplicate, verify, select.

A candidate row carries its parts in ``segments``: ARRAY<STRUCT<start_s, end_s, start_words, start_frame, end_words,
end_frame>>. Parts are few, so what concerns one candidate is an array expression and moves no data.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import clamp, overlap, round_to
from ..functions.text import (
    DEFAULT_TAGS, REFINED_WEAK_OPENERS, SOFT_OPENERS, SPACES, blank_to_null, clean_hashtags, first_number, squeeze,
    strip, tokens,
)
from ..functions.times import minutes_text, parse_frame, parse_seconds
from ..session import cut_lineage, cut_lineage_in_place
from .greedy import select_apart
from .intervals import asof_nearest, interval_join, islands, nearest_within
from .ordered import block_if, max_before, position, row_block, running_sum, sum_before, time_block, with_ordered

SCORES = ("hook_score", "flow_score", "virality_score", "meaning_score", "completeness_score", "boundary_score")
OVERLAP_RATIO = 0.5
CONTIGUOUS_S = 0.5

PART = "start_s double, end_s double, start_words string, start_frame string, end_words string, end_frame string"
RAW_PART = "start string, end string, start_words string, start_frame string, end_words string, end_frame string"
RAW_CANDIDATE = (
    "candidate_id string, rank string, title string, working_title string, youtube_title string, takeaway string,"
    " hook_phrase string, hook_text string, caption string, reason string, description string, description_text string,"
    " description_hashtags string, youtube_tags string, hashtags string, clip_transcript string, start_time string,"
    f" end_time string, {', '.join(s + ' string' for s in SCORES)}, segments array<struct<"
    + ", ".join(p.strip().replace(" ", ":", 1) for p in RAW_PART.split(",")) + ">>"
)


# ---- parts of one candidate -------------------------------------------------------------------------------------


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def coalesced_parts(segments: Column, gap_s: float = CONTIGUOUS_S, strict: bool = False) -> Column:
    """Parts sorted by start with parts inside ``gap_s`` of the last one merged; ``strict`` keeps touching parts apart."""
    spans = F.sort_array(F.transform(segments, lambda p: F.struct(p["start_s"].alias("start_s"), p["end_s"].alias("end_s"))))

    def step(acc, x):
        last = F.element_at(acc, -1)
        near = (x["start_s"] < last["end_s"] + gap_s) if strict else (x["start_s"] <= last["end_s"] + gap_s)
        grown = F.struct(last["start_s"].alias("start_s"), F.greatest(last["end_s"], x["end_s"]).alias("end_s"))
        merged = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(grown))
        return F.when(near, merged).otherwise(F.concat(acc, F.array(x)))

    return bound(spans, lambda sp: F.aggregate(F.slice(sp, F.lit(2), F.greatest(F.size(sp), F.lit(1))), F.slice(sp, 1, 1), step))


def parts_duration(segments: Column) -> Column:
    return F.aggregate(segments, F.lit(0.0), lambda s, p: s + F.greatest(F.lit(0.0), p["end_s"] - p["start_s"]))


def candidate_duration(segments: Column) -> Column:
    """Runtime: seconds of the parts after joining those that touch within half a second."""
    return F.coalesce(parts_duration(coalesced_parts(segments)), F.lit(0.0))


def fix_segment_overlaps(segments: Column) -> Column:
    """Merge strictly overlapping parts; touching parts stay separate."""
    return coalesced_parts(segments, 0.0, strict=True)


def span_durations(parts: DataFrame, keys: Sequence[str], order: Sequence[str], large: bool | None = None) -> DataFrame:
    """``candidate_duration`` for parts held as rows, for groups of any size."""
    block = block_if(large, parts, keys, time_block(order[0]))
    runs = islands(parts, keys, order, gap_s=CONTIGUOUS_S, block=block)
    return runs.groupBy(*keys).agg(
        F.sum(F.greatest(F.lit(0.0), F.col("end_s") - F.col("start_s"))).alias("duration_s"), F.count("*").alias("n_spans")
    )


# ---- intake -----------------------------------------------------------------------------------------------------


def _text_list(c: Column) -> Column:
    """A JSON list of texts, or a space separated text, as an array."""
    as_list = F.from_json(c, "array<string>")
    return F.when(c.startswith("["), F.filter(F.transform(F.coalesce(as_list, F.array()), strip), lambda t: t != "")).otherwise(
        tokens(F.coalesce(c, F.lit("")))
    )


def _capped(c: Column, n: int) -> Column:
    return F.substring(strip(F.coalesce(c, F.lit(""))), 1, n)


def _part(p: Column) -> Column:
    given = p["start"].isNotNull() | p["end"].isNotNull()
    s = F.when(given, parse_seconds(p["start"]))
    e = F.when(given, parse_seconds(p["end"]))
    sf, ef = parse_frame(p["start_frame"]), parse_frame(p["end_frame"])
    usable = s.isNotNull() & e.isNotNull() & (e > s)
    start = F.when(usable, s).otherwise(F.coalesce(sf["a"], s))
    end = F.when(usable, e).otherwise(F.coalesce(ef["b"], sf["b"], e))
    return F.struct(
        start.alias("start_s"), end.alias("end_s"), p["start_words"].alias("start_words"),
        p["start_frame"].alias("start_frame"), p["end_words"].alias("end_words"), p["end_frame"].alias("end_frame"),
    )


def normalize_candidates(raw: DataFrame, limit: int | None = None) -> DataFrame:
    """Raw candidates (``RAW_CANDIDATE`` plus video_id and ord) with types, defaults, caps and part times settled.

    Scores default to 5 and stay in 0..10; completeness and boundary default to flow. Part times come from numbers,
    else from frames, else from the candidate's own times. Candidates without a usable part are dropped.
    """
    score = lambda c: clamp(first_number(c, 5.0), 0.0, 10.0)
    flow = F.coalesce("flow_score", F.lit("5"))
    title = F.substring(strip(F.coalesce(
        blank_to_null(F.col("title")), blank_to_null(F.col("working_title")),
        F.concat(F.lit("Clip "), (F.col("ord") + 1).cast("string")),
    )), 1, 120)
    tag_text = F.array_join(_text_list(F.col("description_hashtags")), " ")
    own_tags = _text_list(F.col("hashtags"))
    parts = F.filter(F.transform(F.coalesce("segments", F.array()), _part), lambda p: p["start_s"].isNotNull() & (p["end_s"] > p["start_s"]))
    own = F.struct(
        parse_seconds(F.col("start_time")).alias("start_s"), parse_seconds(F.col("end_time")).alias("end_s"),
        *[F.lit(None).cast("string").alias(c) for c in ("start_words", "start_frame", "end_words", "end_frame")],
    )
    own_ok = F.col("start_time").isNotNull() & F.col("end_time").isNotNull() & (parse_seconds(F.col("end_time")) > parse_seconds(F.col("start_time")))
    keep = [c for c in ("video_id", "ord", "candidate_id", "source_window") if c in raw.columns]
    out = raw.withColumn("__parts", parts).withColumn(
        "__parts", F.when(F.size("__parts") > 0, F.col("__parts")).when(own_ok, F.array(own))
    ).where(F.col("__parts").isNotNull())
    text = F.coalesce(blank_to_null(F.col("description_text")), F.col("description"))
    out = out.select(
        *keep,
        F.coalesce(F.col("rank").try_cast("int"), F.col("ord").cast("int") + 1).alias("rank"),
        title.alias("title"), F.coalesce("working_title", title).alias("working_title"),
        score(F.col("hook_score")).alias("hook_score"), score(flow).alias("flow_score"),
        score(F.col("virality_score")).alias("virality_score"), score(F.col("meaning_score")).alias("meaning_score"),
        score(F.coalesce("completeness_score", flow)).alias("completeness_score"),
        score(F.coalesce("boundary_score", flow)).alias("boundary_score"),
        _capped(F.col("reason"), 280).alias("reason"), _capped(F.col("takeaway"), 280).alias("takeaway"),
        _capped(F.col("hook_phrase"), 140).alias("hook_phrase"), _capped(F.col("youtube_title"), 110).alias("youtube_title"),
        _capped(text, 700).alias("description_text"),
        F.substring(F.when(F.col("description_hashtags").startswith("["), tag_text).otherwise(strip(F.coalesce("description_hashtags", F.lit("")))), 1, 1500).alias("description_hashtags"),
        _capped(F.col("youtube_tags"), 600).alias("youtube_tags"), _capped(F.col("hook_text"), 220).alias("hook_text"),
        _capped(F.col("caption"), 180).alias("caption"), F.col("clip_transcript"),
        F.slice(clean_hashtags(F.when(F.size(own_tags) > 0, own_tags).otherwise(_text_list(F.col("description_hashtags")))), 1, 40).alias("hashtags"),
        F.col("__parts").alias("segments"),
    ).withColumns({
        "start_s": F.col("segments")[0]["start_s"], "end_s": F.element_at("segments", -1)["end_s"],
    })
    if limit is None:
        return out
    ranked = with_ordered(out, ["video_id"], ["ord"], {"__i": position()}, block_if(None, out, ["video_id"], row_block("ord")))
    return ranked.where(F.col("__i") < limit).drop("__i")


def response_quality(candidates: Column) -> Column:
    """Quality of a response: anchored candidates count, with extras for more parts and filled-in metadata."""
    filled = lambda c, w: F.when(blank_to_null(c).isNotNull(), F.lit(w)).otherwise(F.lit(0.0))

    def points(c):
        anchored = F.size(F.filter(
            F.coalesce(c["segments"], F.array()),
            lambda p: blank_to_null(p["start_words"]).isNotNull() & blank_to_null(p["end_words"]).isNotNull(),
        ))
        extra = (
            F.least(anchored - 1, F.lit(5)) * 0.3
            + filled(c["takeaway"], 0.15) + filled(c["youtube_title"], 0.15) + filled(c["hook_phrase"], 0.15)
            + filled(c["description_text"], 0.10) + filled(c["description_hashtags"], 0.10)
            + filled(c["youtube_tags"], 0.10) + filled(c["reason"], 0.05)
        )
        return F.when(anchored > 0, F.lit(1.0) + extra).otherwise(F.lit(0.0))

    return F.aggregate(F.coalesce(candidates, F.array()), F.lit(0.0), lambda s, c: s + points(c))


def best_of(responses: DataFrame, keys: Sequence[str], score: Column, order: str) -> DataFrame:
    """Per task the response with the highest score, the earliest of equals. One map-side combined aggregation."""
    rest = [c for c in responses.columns if c not in keys]
    pick = F.max_by(F.struct(*rest), F.struct(score, -F.col(order)))
    return responses.groupBy(*keys).agg(pick.alias("__best")).select(*keys, "__best.*")


def merge_window_outputs(parsed: DataFrame, bounds: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidates, chapters, summaries) of all windows of a video.

    parsed (video_id, window, candidates ARRAY, chapters ARRAY, summary); bounds (video_id, window, window_start,
    window_end). Candidates get the id ``wNN_cNN`` and their window and its bounds; windows count from 0.
    """
    cands = (
        parsed.select("video_id", "window", F.posexplode("candidates").alias("__i", "__c"))
        .join(bounds, ["video_id", "window"])
        .select(
            "video_id", F.format_string("w%02d_c%02d", F.col("window") + 1, F.col("__i") + 1).alias("candidate_id"),
            (F.col("window") + 1).alias("source_window"), round_to(F.col("window_start")).alias("source_window_start"),
            round_to(F.col("window_end")).alias("source_window_end"), F.col("__c").alias("candidate"),
        )
    )
    chapters = parsed.select("video_id", "window", F.posexplode("chapters").alias("chapter_no", "chapter"))
    said = parsed.where(blank_to_null(F.col("summary")).isNotNull()).groupBy("video_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("window", "summary"))), lambda x: x["summary"]), " ").alias("summary")
    )
    return cands, chapters, said


# ---- text behind a candidate ------------------------------------------------------------------------------------


def _parts_as_rows(candidates: DataFrame) -> DataFrame:
    return candidates.select(
        "video_id", "candidate_id", F.posexplode("segments").alias("part", "__p")
    ).select("video_id", "candidate_id", "part", F.col("__p.start_s").alias("p_start"), F.col("__p.end_s").alias("p_end"))


def candidate_text(
    candidates: DataFrame, segments: DataFrame, limit: int | None = 1800, snap_s: float | None = 3.0, name: str = "evidence"
) -> DataFrame:
    """Text of the transcript segments a candidate overlaps, after moving each side to the closest segment edge.

    Both sides and the overlap are bucketed joins over a few seconds. ``snap_s=None`` takes the times as they are.
    """
    parts = _parts_as_rows(candidates)
    ids = ["candidate_id", "part"]
    if snap_s is not None:
        parts = nearest_within(parts, segments, ["video_id"], "p_start", "start_s", ids, snap_s, "__s")
        parts = nearest_within(parts, segments, ["video_id"], "p_end", "end_s", ids, snap_s, "__e")
        parts = parts.select(
            "video_id", *ids, F.coalesce("__s", "p_start").alias("p_start"), F.coalesce("__e", "p_end").alias("p_end")
        )
    hit = interval_join(
        parts.where("p_start < p_end"), segments.select("video_id", "seg_id", "start_s", "end_s", "text"), ["video_id"],
        ("p_start", "p_end"), ("start_s", "end_s"),
    ).where(strip(F.col("text")) != "")
    item = F.struct("part", "seg_id", F.col("text"))
    said = hit.groupBy("video_id", "candidate_id").agg(F.sort_array(F.collect_list(item)).alias("__t"))
    text = squeeze(F.array_join(F.transform("__t", lambda x: x["text"]), " "))
    said = said.select("video_id", "candidate_id", (F.substring(text, 1, limit) if limit else text).alias(name))
    return candidates.join(said, ["video_id", "candidate_id"], "left").withColumn(name, F.coalesce(name, F.lit("")))


def word_exact_text(
    plans: DataFrame, segments: DataFrame, words: DataFrame, tolerance_s: float = 0.05, name: str = "transcript_text"
) -> DataFrame:
    """Words whose midpoint lies in a part; segments that have no words give their whole text."""
    hit = interval_join(
        _parts_as_rows(plans).where("p_start < p_end"), segments.select("video_id", "seg_id", "start_s", "end_s", "text"),
        ["video_id"], ("p_start", "p_end"), ("start_s", "end_s"),
    )
    own = words.select(
        "video_id", "seg_id", "word_idx", "word", ((F.col("start_s") + F.col("end_s")) / 2).alias("__mid")
    )
    joined = hit.join(own, ["video_id", "seg_id"], "left")
    inside = F.col("__mid").between(F.col("p_start") - tolerance_s, F.col("p_end") + tolerance_s)
    token = F.when(F.col("word_idx").isNull(), strip(F.col("text"))).when(inside, strip(F.col("word")))
    said = (
        joined.withColumn("__tok", token).where(F.col("__tok") != "")
        .groupBy("video_id", "candidate_id")
        .agg(F.sort_array(F.collect_list(F.struct("part", "seg_id", "word_idx", "__tok"))).alias("__t"))
        .select("video_id", "candidate_id", F.array_join(F.transform("__t", lambda x: x["__tok"]), " ").alias(name))
    )
    return plans.join(said, ["video_id", "candidate_id"], "left").withColumn(name, F.coalesce(name, F.lit("")))


# ---- scoring ----------------------------------------------------------------------------------------------------


def quality_score(scores: Sequence[Column] | None = None) -> Column:
    cols = [F.col(s) for s in SCORES] if scores is None else list(scores)
    out = F.lit(0.0)
    for c in cols:
        out = out + c
    return out


def duration_penalty(duration: Column, min_s: float, max_s: float) -> Column:
    """0.15 per second short; 0.05 per second over for a minute, then 3 plus 0.15 per second."""
    over = duration - max_s
    return (
        F.when(duration < min_s, (min_s - duration) * 0.15)
        .when((duration > max_s) & (over <= 60.0), over * 0.05)
        .when(duration > max_s, 3.0 + (over - 60.0) * 0.15)
        .otherwise(F.lit(0.0))
    )


def master_score(duration: Column, min_s: float, max_s: float, quality: Column | None = None) -> Column:
    return round_to((quality_score() if quality is None else quality) - duration_penalty(duration, min_s, max_s))


def repair_metadata(candidates: DataFrame, evidence: str = "evidence") -> DataFrame:
    """Fill in missing titles, captions, descriptions and tags from the evidence text."""
    ev = F.col(evidence)
    cleaned = clean_hashtags(F.coalesce("hashtags", F.array().cast("array<string>")))
    pool = F.array(*[F.lit(t) for t in DEFAULT_TAGS])
    missing = F.filter(pool, lambda t: ~F.array_contains(F.col("__tags"), t))
    padded = F.when(F.size("__tags") < 10, F.concat("__tags", F.slice(missing, F.lit(1), F.greatest(F.lit(0), 10 - F.size("__tags"))))).otherwise(F.col("__tags"))
    title = strip(F.coalesce("title", F.lit("")))
    generic = F.lower(title).isin("", "untitled clip", "clip") | title.startswith("Clip ")
    opening = tokens(ev)
    from_evidence = F.when(
        F.size(opening) >= 3,
        F.concat(F.regexp_replace(F.array_join(F.slice(opening, 1, 5), " "), r"^[.,!?]+|[.,!?]+$", ""), F.lit("...")),
    ).otherwise(F.lit("Valuable Insight"))
    return candidates.withColumn("__tags", cleaned).withColumns({
        "hashtags": F.slice(padded, 1, 15),
        "title": F.when(generic, from_evidence).otherwise(F.col("title")),
        "caption": F.coalesce(
            blank_to_null(F.col("caption")),
            F.when(F.length(ev) > 150, F.concat(strip(F.substring(ev, 1, 150)), F.lit("..."))).otherwise(strip(ev)),
        ),
        "description": F.coalesce(
            blank_to_null(F.col("description")),
            F.concat(F.lit("An interesting highlight: "), strip(F.substring(ev, 1, 400)), F.lit("...")),
        ),
    }).drop("__tags")


def stitch_extend(candidates: DataFrame, segments: DataFrame, min_s: float, large: bool | None = None) -> DataFrame:
    """Lengthen candidates under ``min_s`` with the segments that follow, then with those before.

    The end segments are those whose edge lies within half a second (first for the start, last for the end), else
    the nearest. How far a candidate can reach is known on the axis of covered seconds: it meets only the segments
    within its shortfall on that axis, and takes them in order until it is long enough.
    """
    block = block_if(large, segments, ["video_id"], row_block("seg_id"))
    # of segments that overlap only what reaches past all before counts
    ends = with_ordered(segments.select("video_id", "seg_id", "start_s", "end_s"), ["video_id"], ["seg_id"], {"__m": max_before(F.col("end_s"))}, block)
    covered = F.greatest(F.lit(0.0), F.col("end_s") - F.greatest(F.col("start_s"), F.coalesce("__m", F.col("start_s"))))
    axis = with_ordered(
        ends.withColumn("__len", covered), ["video_id"], ["seg_id"], {"__p0": sum_before(F.col("__len"))}, block,
    ).withColumn("__p1", F.col("__p0") + F.col("__len"))
    short = (
        candidates.where((F.size("segments") > 0) & (candidate_duration(F.col("segments")) < min_s))
        .select("video_id", "candidate_id", "segments", candidate_duration(F.col("segments")).alias("__dur"))
        .withColumns({"__fs": F.col("segments")[0]["start_s"], "__le": F.element_at("segments", -1)["end_s"]})
    )
    cut = cut_lineage_in_place if large is False else cut_lineage
    short, axis = cut(short), cut(axis)
    first = _edge_segment(short, axis, "__fs", "start_s", earliest=True, large=large)
    last = _edge_segment(short, axis, "__le", "end_s", earliest=False, large=large)
    both = short.join(first.withColumnsRenamed({"seg": "__fi", "close": "__fc", "far": "__ff"}), ["video_id", "candidate_id"])
    both = both.join(last.withColumnsRenamed({"seg": "__li", "close": "__lc", "far": "__lf"}), ["video_id", "candidate_id"])
    exact = F.col("__fc").isNotNull() & F.col("__lc").isNotNull()
    both = both.withColumns({
        "__first": F.when(exact, F.col("__fc")).otherwise(F.col("__ff")),
        "__last": F.when(exact, F.col("__lc")).otherwise(F.col("__lf")),
        "__need": F.lit(float(min_s)) - F.col("__dur") + 1.0,
    }).where(F.col("__first").isNotNull() & F.col("__last").isNotNull())
    spots = axis.select("video_id", F.col("seg_id").alias("__first"), F.col("__p0").alias("__a0"))
    spots2 = axis.select("video_id", F.col("seg_id").alias("__last"), F.col("__p1").alias("__a1"))
    reach = both.join(spots, ["video_id", "__first"]).join(spots2, ["video_id", "__last"]).withColumns({
        "__lo": F.col("__a0") - F.col("__need"), "__hi": F.col("__a1") + F.col("__need"),
    })
    near = interval_join(
        reach.select("video_id", "candidate_id", "__first", "__last", "__lo", "__hi"),
        axis.where("end_s > start_s"), ["video_id"], ("__lo", "__hi"), ("__p0", "__p1"), closed=True,
    ).where((F.col("seg_id") > F.col("__last")) | (F.col("seg_id") < F.col("__first")))
    span = F.struct("seg_id", "start_s", "end_s")
    around = near.groupBy("video_id", "candidate_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("seg_id") > F.col("__last"), span))).alias("__after"),
        F.reverse(F.sort_array(F.collect_list(F.when(F.col("seg_id") < F.col("__first"), span)))).alias("__before"),
    )
    grown = both.join(around, ["video_id", "candidate_id"])
    blank = lambda s, e: F.struct(
        s.alias("start_s"), e.alias("end_s"), *[F.lit(None).cast("string").alias(c) for c in ("start_words", "start_frame", "end_words", "end_frame")]
    )

    def moved(p, s, e):
        return F.struct(s.alias("start_s"), e.alias("end_s"), *[p[c].alias(c) for c in ("start_words", "start_frame", "end_words", "end_frame")])

    def step(s, more):
        grown_ = bound(more, lambda m: F.struct(m.alias("parts"), candidate_duration(m).alias("dur")))
        return F.when(s["dur"] >= min_s, s).otherwise(grown_)

    def forward(s, x):
        acc = s["parts"]
        last_ = F.element_at(acc, -1)
        touching = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(moved(last_, last_["start_s"], x["end_s"])))
        more = F.when(x["start_s"] <= last_["end_s"] + CONTIGUOUS_S, touching).otherwise(F.concat(acc, F.array(blank(x["start_s"], x["end_s"]))))
        return step(s, more)

    def backward(s, x):
        acc = s["parts"]
        head = F.element_at(acc, 1)
        touching = F.concat(F.array(moved(head, x["start_s"], head["end_s"])), F.slice(acc, F.lit(2), F.greatest(F.size(acc), F.lit(1))))
        more = F.when(x["end_s"] >= head["start_s"] - CONTIGUOUS_S, touching).otherwise(F.concat(F.array(blank(x["start_s"], x["end_s"])), acc))
        return step(s, more)

    fields = ", ".join(p.strip().replace(" ", ":", 1) for p in PART.split(","))
    state = f"struct<parts:array<struct<{fields}>>,dur:double>"
    start = F.struct(F.col("segments").alias("parts"), F.col("__dur").alias("dur")).cast(state)
    grown = grown.withColumn("__new", F.aggregate("__after", start, lambda s, x: forward(s, x).cast(state)))
    grown = grown.withColumn("__new", F.aggregate("__before", F.col("__new"), lambda s, x: backward(s, x).cast(state)))
    grown = grown.withColumn("__new", F.col("__new.parts"))
    out = candidates.join(grown.select("video_id", "candidate_id", "__new"), ["video_id", "candidate_id"], "left")
    return out.withColumn("segments", F.coalesce("__new", F.col("segments"))).drop("__new")


def _edge_segment(
    short: DataFrame, axis: DataFrame, point: str, edge: str, earliest: bool, large: bool | None
) -> DataFrame:
    """(close, far): the segment whose edge lies within half a second of the point, and the nearest of all."""
    probe = short.select("video_id", "candidate_id", F.col(point).alias("__t"))
    wide = probe.withColumns({"__lo": F.col("__t") - 0.5, "__hi": F.col("__t") + 0.5})
    spots = axis.select("video_id", F.col("seg_id").alias("__sid"), F.col(edge).alias("__at"), F.col(edge).alias("__at2"))
    hit = interval_join(wide, spots, ["video_id"], ("__lo", "__hi"), ("__at", "__at2"), closed=True).where(
        F.abs(F.col("__at") - F.col("__t")) < 0.5
    )
    pick = F.min("__sid") if earliest else F.max("__sid")
    close = hit.groupBy("video_id", "candidate_id").agg(pick.alias("close"))
    block_s = 3600.0 if (large or large is None) else None
    far = asof_nearest(
        probe, axis.select("video_id", F.col("seg_id").alias("far"), F.col(edge).alias("__edge")), ["video_id"], "__t", "__edge",
        ["far"], ["candidate_id"], block_s=block_s,
    ).select("video_id", "candidate_id", "far")
    return far.join(close, ["video_id", "candidate_id"], "left").withColumn("seg", F.coalesce("close", "far"))


def filter_and_score(
    candidates: DataFrame, segments: DataFrame, min_s: float, max_s: float, require_metadata: bool = False,
    large: bool | None = None,
) -> DataFrame:
    """Extend short candidates, drop empty and far too long ones, attach evidence, repair metadata, score."""
    if "start_s" in candidates.columns and "end_s" in candidates.columns:
        # no parts, but times of its own: one part
        bare = (F.coalesce(F.size("segments"), F.lit(0)) <= 0) & (F.col("end_s") > F.col("start_s"))
        names = [f.name for f in candidates.schema["segments"].dataType.elementType.fields]
        whole = F.struct(*[F.col(n).alias(n) if n in ("start_s", "end_s") else F.lit(None).alias(n) for n in names])
        kind = candidates.schema["segments"].dataType.simpleString()
        candidates = candidates.withColumn("segments", F.when(bare, F.array(whole).cast(kind)).otherwise(F.col("segments")))
    good = F.filter(F.col("segments"), lambda p: p["end_s"] > p["start_s"])
    ready = candidates.withColumn("segments", F.when(F.size(good) > 0, good).otherwise(F.col("segments")))
    grown = stitch_extend(ready, segments, min_s, large)
    # read several times below: the extension is worked out once
    cut = cut_lineage_in_place if large is False else cut_lineage
    timed = cut(grown.withColumn("__dur", candidate_duration(F.col("segments"))).where(
        (F.col("__dur") > 0) & (F.col("__dur") <= max_s + 90.0)
    ))
    told = candidate_text(timed, segments, 20000, name="content").withColumn("evidence", F.substring("content", 1, 1800))
    fixed = repair_metadata(told)
    if require_metadata:
        full = lambda c: blank_to_null(F.col(c)).isNotNull()
        fixed = fixed.where(full("title") & full("caption") & full("description") & (F.size("hashtags") >= 10))
    return fixed.withColumns({
        "total_duration": round_to(F.col("__dur")),
        "master_score": master_score(F.col("__dur"), min_s, max_s),
        "start_s": F.col("segments")[0]["start_s"], "end_s": F.element_at("segments", -1)["end_s"],
    }).drop("__dur")


# ---- duplicates -------------------------------------------------------------------------------------------------


def dedupe_candidates(
    candidates: DataFrame, keys: Sequence[str], score: str, row_id: Sequence[str], ratio: float = OVERLAP_RATIO,
    small_group: int = 5000, large: bool | None = None, cell_s: float = 60.0,
) -> DataFrame:
    """Drop a candidate whose outer span shares more than ``ratio`` of the shorter one with a better kept one."""

    def conflict(k, x):
        shared = F.greatest(F.lit(0.0), overlap(k["start_s"], k["end_s"], x["start_s"], x["end_s"]))
        shorter = F.least(
            F.greatest(F.lit(0.1), k["end_s"] - k["start_s"]), F.greatest(F.lit(0.1), x["end_s"] - x["start_s"])
        )
        return shared / shorter > ratio

    ranked = candidates.withColumn("__worst", -F.coalesce(score, F.lit(0.0)))
    return select_apart(
        ranked, keys, ["__worst", *row_id], row_id, conflict, cell_s=cell_s, small_group=small_group, large=large
    ).drop("__worst")


def remove_overlaps(
    plans: DataFrame, keys: Sequence[str], row_id: Sequence[str], ratio: float = OVERLAP_RATIO, score: str = "master_score",
    small_group: int = 5000, large: bool | None = None,
) -> DataFrame:
    """Drop a plan that shares more than ``ratio`` of the shorter runtime, over all pairs of parts, with a better kept one."""
    runtime = lambda p: F.coalesce(F.nullif(parts_duration(p), F.lit(0.0)), F.lit(1.0))

    def conflict(k, x):
        shared = F.aggregate(
            k["segments"], F.lit(0.0),
            lambda s, a: s + F.aggregate(
                x["segments"], F.lit(0.0),
                lambda t, b: t + F.greatest(F.lit(0.0), overlap(a["start_s"], a["end_s"], b["start_s"], b["end_s"])),
            ),
        )
        return shared / F.least(k["__run"], x["__run"]) > ratio

    slim = F.transform("segments", lambda p: F.struct(p["start_s"].alias("start_s"), p["end_s"].alias("end_s")))
    ranked = plans.select(*keys, *row_id, score, slim.alias("segments")).withColumns({
        "__worst": -F.coalesce(score, F.lit(0.0)), "__run": runtime(F.col("segments")),
        "start_s": F.array_min(F.transform("segments", lambda p: p["start_s"])),
        "end_s": F.array_max(F.transform("segments", lambda p: p["end_s"])),
    })
    kept = select_apart(
        ranked, keys, ["__worst", *row_id], row_id, conflict, payload=["segments", "__run"], small_group=small_group, large=large
    )
    return plans.join(kept.select(*keys, *row_id), [*keys, *row_id], "left_semi")


def refine_merge(
    originals: DataFrame, refined: DataFrame, segments: DataFrame, min_s: float, max_s: float, batch: int = 5,
    large: bool | None = None,
) -> DataFrame:
    """Refined candidates per batch of originals, de-duplicated and scored; originals not returned are kept.

    originals carry ``ord``; refined carry the batch they answer, counted from 0, and an ``ord`` unique in it. An answer without id takes that of
    its batch's only original; in larger batches it stays without one, and stands beside the originals. Ids may repeat between batches:
    answers are told apart by batch and ``ord``. Answers to batches that do not exist are left out.
    """
    order = with_ordered(originals, ["video_id"], ["ord"], {"__i": position()}, block_if(large, originals, ["video_id"], row_block("ord")))
    batches = order.withColumn("batch", F.floor(F.col("__i") / batch)).drop("__i")
    single = batches.groupBy("video_id", "batch").agg(F.count("*").alias("__n"), F.first("candidate_id").alias("__only"))
    answered = refined.join(single, ["video_id", "batch"]).withColumn(
        "__id", F.when(F.col("__n") == 1, F.coalesce("candidate_id", "__only")).otherwise(F.col("candidate_id"))
    ).drop("__n", "__only").withColumn("candidate_id", F.concat_ws("/", F.col("batch").cast("string"), F.col("ord").cast("string")))
    unique = dedupe_candidates(
        answered.withColumn("__q", F.coalesce(F.col("master_score"), quality_score()) if "master_score" in answered.columns else quality_score()),
        ["video_id", "batch"], "__q", ["ord", "candidate_id"], large=large,
    ).drop("__q")
    scored = filter_and_score(unique, segments, min_s, max_s, large=large).withColumn("candidate_id", F.col("__id")).drop("__id").withColumn("refined", F.lit(True))
    left = batches.join(scored.select("video_id", "batch", "candidate_id"), ["video_id", "batch", "candidate_id"], "left_anti")
    return scored.unionByName(left.withColumn("refined", F.lit(False)), allowMissingColumns=True)


# ---- verification and compression -------------------------------------------------------------------------------


def verification_reason(parts: Column, original_parts: Column, min_s: float) -> Column:
    """Why a refined candidate needs another look; NULL when it does not. The first reason counts."""
    frame_span = F.filter(F.transform(parts, _frame_or_times), lambda p: p["end_s"] > p["start_s"])
    estimate = F.coalesce(parts_duration(coalesced_parts(frame_span)), F.lit(0.0))
    opening = F.lower(F.regexp_replace(strip(F.coalesce(parts[0]["start_words"], F.lit(""))), r"^[^A-Za-z0-9]+", ""))
    first = F.get(F.split(opening, SPACES, 2), F.lit(0))
    # one pattern: a branch per phrase would make the opening anew for each
    soft = opening.rlike("^(?:" + "|".join(re.escape(p) for p in SOFT_OPENERS) + ")")
    return (
        F.when(F.size(parts) < F.size(original_parts), F.lit("fewer_parts"))
        .when(F.size(parts) == 0, F.lit("no_parts"))
        .when(estimate < 0.7 * min_s, F.lit("too_short"))
        .when(first.isin(*REFINED_WEAK_OPENERS), F.lit("weak_opener"))
        .when(soft, F.lit("soft_opener"))
    )


def _frame_or_times(p: Column) -> Column:
    sf, ef = parse_frame(p["start_frame"]), parse_frame(p["end_frame"])
    framed = sf.isNotNull() & ef.isNotNull() & (ef["b"] > sf["a"])
    return F.struct(
        F.when(framed, sf["a"]).otherwise(p["start_s"]).alias("start_s"), F.when(framed, ef["b"]).otherwise(p["end_s"]).alias("end_s")
    )


def flag_needs_verification(refined: DataFrame, originals: DataFrame, min_s: float) -> DataFrame:
    orig = originals.select("video_id", "candidate_id", F.col("segments").alias("__orig"))
    joined = refined.join(orig, ["video_id", "candidate_id"], "left").withColumn("__orig", F.coalesce("__orig", "segments"))
    return joined.withColumn("verify_reason", verification_reason(F.col("segments"), F.col("__orig"), min_s)).drop("__orig")


def accept_verified(
    refined: DataFrame, originals: DataFrame, verified: DataFrame, min_s: float, winners: DataFrame | None = None
) -> DataFrame:
    """Replace flagged candidates by their verified version when that one is not flagged again.

    verified (video_id, candidate_id, segments). winners (video_id, candidate_id, winner, proposed) settles what is
    still flagged: A keeps, B takes the verified parts, C takes the proposed parts when there are any.
    """
    flagged = flag_needs_verification(refined, originals, min_s)
    new = verified.select("video_id", "candidate_id", F.col("segments").alias("__new"))
    orig = originals.select("video_id", "candidate_id", F.col("segments").alias("__orig"))
    joined = flagged.join(new, ["video_id", "candidate_id"], "left").join(orig, ["video_id", "candidate_id"], "left")
    joined = joined.withColumn("__orig", F.coalesce("__orig", "segments"))
    asked = F.col("verify_reason").isNotNull() & F.col("__new").isNotNull()
    again = verification_reason(F.col("__new"), F.col("__orig"), min_s)
    joined = joined.withColumn("__bad", asked & again.isNotNull())
    better = F.when(asked & ~F.col("__bad"), F.col("__new"))
    if winners is not None:
        votes = winners.select("video_id", "candidate_id", F.upper(F.trim("winner")).alias("__w"), F.col("proposed").alias("__c"))
        joined = joined.join(votes, ["video_id", "candidate_id"], "left")
        better = better.when(F.col("__bad") & (F.col("__w") == "B") & (F.size("__new") > 0), F.col("__new"))
        better = better.when(F.col("__bad") & (F.col("__w") == "C") & (F.size("__c") > 0), F.col("__c"))
    return joined.withColumn("segments", F.coalesce(better, F.col("segments"))).select(*refined.columns, "verify_reason")


def apply_compression(candidates: DataFrame, compressed: DataFrame, max_s: float) -> DataFrame:
    """Take the compressed parts of over-long candidates when any came back; all others stay.

    compressed (video_id, candidate_id, segments ARRAY<STRUCT<start, end>> of text or numbers, compression_note).
    """
    parts = F.filter(
        F.transform("segments", lambda p: F.struct(
            parse_seconds(p["start"]).alias("start_s"), parse_seconds(p["end"]).alias("end_s"),
            *[F.lit(None).cast("string").alias(c) for c in ("start_words", "start_frame", "end_words", "end_frame")],
        )),
        lambda p: p["end_s"] > p["start_s"],
    )
    back = compressed.select("video_id", "candidate_id", parts.alias("__new"), strip(F.coalesce("compression_note", F.lit(""))).alias("__note"))
    joined = candidates.join(back.where(F.size("__new") > 0), ["video_id", "candidate_id"], "left")
    take = F.col("__new").isNotNull() & (candidate_duration(F.col("segments")) > max_s)
    return joined.withColumn("__take", take).withColumns({
        "segments": F.when(F.col("__take"), F.col("__new")).otherwise(F.col("segments")),
        "compression_note": F.when(F.col("__take"), F.col("__note")),
    }).withColumns({
        "start_s": F.col("segments")[0]["start_s"], "end_s": F.element_at("segments", -1)["end_s"],
    }).drop("__new", "__note", "__take")


# ---- context ----------------------------------------------------------------------------------------------------


def context_lines(
    candidates: DataFrame, segments: DataFrame, before_s: float = 15.0, after_s: float = 40.0, slack_s: float = 0.1,
    max_lines: int = 100, max_words: int = 2000,
) -> DataFrame:
    """Transcript lines around a candidate, marked SELECTED inside any part and CONTEXT outside; a line and word budget ends them."""
    good = F.filter("segments", lambda p: p["end_s"] > p["start_s"])
    outer = candidates.select("video_id", "candidate_id", good.alias("__parts")).where(F.size("__parts") > 0).select(
        "video_id", "candidate_id", "__parts",
        F.greatest(F.lit(0.0), F.array_min(F.transform("__parts", lambda p: p["start_s"])) - before_s).alias("c_start"),
        (F.array_max(F.transform("__parts", lambda p: p["end_s"])) + after_s).alias("c_end"),
    )
    hit = interval_join(
        outer, segments.select("video_id", "seg_id", "start_s", "end_s", "text"), ["video_id"], ("c_start", "c_end"),
        ("start_s", "end_s"), closed=True,
    )
    inside = F.exists("__parts", lambda p: (F.col("start_s") >= p["start_s"] - slack_s) & (F.col("end_s") <= p["end_s"] + slack_s))
    two = lambda c: F.format_string("%.2f", c)
    lined = hit.withColumns({"__text": squeeze(F.col("text")), "selected": inside}).where("__text <> ''").withColumn(
        "line",
        F.concat(
            F.lit("["), F.when(F.col("selected"), "SELECTED").otherwise("CONTEXT"), F.lit(" "), two(F.col("start_s")), F.lit("s ("),
            minutes_text(F.col("start_s")), F.lit(") -> "), two(F.col("end_s")), F.lit("s ("), minutes_text(F.col("end_s")), F.lit(")] "), F.col("__text"),
        ),
    )
    key = ["video_id", "candidate_id"]
    counted = with_ordered(
        lined.withColumn("__words", F.size(tokens(F.col("line")))), key, ["seg_id"],
        {"line_no": position(), "__used": running_sum(F.col("__words"))},
    )
    over = F.min(F.when(F.col("__used") > max_words, F.col("line_no"))).over(Window.partitionBy(*key))
    return counted.withColumn("__over", over).where(
        (F.col("line_no") < max_lines) & (F.col("__over").isNull() | (F.col("line_no") < F.col("__over")))
    ).select(*key, "line_no", "seg_id", "selected", "line")


def anchor_summary(candidates: DataFrame, segments: DataFrame) -> DataFrame:
    """First 5 hook words, last 5 evidence words, and the frame of the last segment that holds each end.

    A segment holds a time inside it or within half a second of its start.
    """
    five = lambda c, tail: F.array_join(
        F.slice(tokens(c), F.greatest(F.lit(1), F.size(tokens(c)) - 4), 5) if tail else F.slice(tokens(c), 1, 5), " "
    )
    said = F.coalesce(blank_to_null(F.col("evidence")), F.col("reason"), F.lit(""))
    probe = candidates.select("video_id", "candidate_id", F.inline(F.array(
        F.struct(F.lit("start").alias("side"), F.col("start_s").alias("__t")), F.struct(F.lit("end").alias("side"), F.col("end_s").alias("__t")),
    ))).withColumn("__t2", F.col("__t"))
    held = segments.select(
        "video_id", F.col("seg_id").alias("__sid"), F.col("start_s").alias("__s"), F.col("end_s").alias("__e"),
        (F.col("start_s") - 0.5).alias("__lo"), F.greatest(F.col("end_s"), F.col("start_s") + 0.5).alias("__hi"),
    )
    hit = interval_join(probe, held, ["video_id"], ("__t", "__t2"), ("__lo", "__hi"), closed=True)
    frame = F.concat(F.lit("["), minutes_text(F.col("__s")), F.lit(" -> "), minutes_text(F.col("__e")), F.lit("]"))
    frames = hit.groupBy("video_id", "candidate_id").agg(*[
        F.max_by(F.when(F.col("side") == s, frame), F.when(F.col("side") == s, F.col("__sid"))).alias(f"{s}_frame") for s in ("start", "end")
    ])
    zero = F.lit("[00:00.00 -> 00:00.00]")
    return candidates.join(frames, ["video_id", "candidate_id"], "left").select(
        "video_id", "candidate_id", five(F.coalesce("hook_text", F.lit("")), False).alias("start_anchor"), five(said, True).alias("end_anchor"),
        F.coalesce("start_frame", zero).alias("start_frame"), F.coalesce("end_frame", zero).alias("end_frame"),
    )
