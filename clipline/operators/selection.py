"""Merging neighbours, building plans, review decisions, and the top spans per video."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import round_to
from ..functions.text import blank_to_null, strip, tokens
from .candidates import fix_segment_overlaps, parts_duration, word_exact_text
from .greedy import greedy_select
from .intervals import asof_nearest
from .ordered import block_if, lag, lead, time_block, with_ordered


def _runtime(segments: Column) -> Column:
    return F.coalesce(parts_duration(segments), F.lit(0.0))


def is_resolved(segments: Column) -> Column:
    """Every part has an end after its start."""
    bad = F.filter(segments, lambda p: ~F.coalesce(p["end_s"] > p["start_s"], F.lit(False)))
    return (F.size(segments) > 0) & (F.size(bad) == 0)


# ---- merging ----------------------------------------------------------------------------------------------------


def find_short_with_neighbours(candidates: DataFrame, min_s: float, large: bool | None = None) -> DataFrame:
    """Candidates under ``min_s`` with the ones before and after in time and the gap to each.

    Needs video_id, candidate_id and ``segments``; candidates without settled times take no part.
    """
    timed = candidates.where(is_resolved(F.col("segments"))).select(
        "video_id", "candidate_id", F.col("segments")[0]["start_s"].alias("start_s"),
        F.element_at("segments", -1)["end_s"].alias("end_s"), _runtime(F.col("segments")).alias("duration_s"),
    )
    return neighbours(timed, large).where(F.col("duration_s") < min_s)


def neighbours(spans: DataFrame, large: bool | None = None) -> DataFrame:
    """Previous and next span by start, with gap seconds. spans (video_id, candidate_id, start_s, end_s, ...)."""
    block = block_if(large, spans, ["video_id"], time_block("start_s"))
    me = F.struct("candidate_id", "start_s", "end_s")
    near = with_ordered(spans, ["video_id"], ["start_s", "candidate_id"], {"__p": lag(me), "__n": lead(me)}, block)
    return near.withColumns({
        "prev_id": F.col("__p.candidate_id"), "next_id": F.col("__n.candidate_id"),
        "gap_before_s": F.col("start_s") - F.col("__p.end_s"), "gap_after_s": F.col("__n.start_s") - F.col("end_s"),
    }).drop("__p", "__n")


def validate_merges(proposals: DataFrame, small_group: int = 5000) -> DataFrame:
    """Proposals with two or more ids, in order, dropping any that reuses an id of a kept one.

    proposals (video_id, merge_no, merge_ids ARRAY<STRING>, reason). The ids are the cells of the selection, so
    proposals meet only through an id they share.
    """
    ids = F.filter(F.transform("merge_ids", strip), lambda i: i != "")
    clean = proposals.withColumns({"merge_ids": ids, "reason": F.substring(F.coalesce("reason", F.lit("")), 1, 240)}).where(
        F.size("merge_ids") >= 2
    )
    return greedy_select(
        clean, ["video_id"], ["merge_no"], ["merge_no"], ["merge_ids"],
        lambda k, x: F.arrays_overlap(k["merge_ids"], x["merge_ids"]),
        F.transform("merge_ids", lambda i: F.xxhash64(i)), small_group,
    )


def apply_merges(
    candidates: DataFrame, merges: DataFrame, max_s: float, fused: DataFrame | None = None
) -> DataFrame:
    """Replace the members of each merge by one candidate with all their parts in time order.

    Merges are valid ones (no shared ids). A merge needs two known members and at most ``max_s`` + 30 seconds. The
    best member by master, virality and hook score gives the metadata; ``fused`` (video_id, merge_no, youtube_title,
    description_text, ...) overlays it.
    """
    wanted = merges.select("video_id", "merge_no", "reason", F.explode("merge_ids").alias("candidate_id")).dropDuplicates(
        ["video_id", "merge_no", "candidate_id"]
    )
    members = candidates.where(is_resolved(F.col("segments"))).join(wanted, ["video_id", "candidate_id"])
    rest = [c for c in candidates.columns if c not in ("video_id", "candidate_id", "segments")]
    start = F.col("segments")[0]["start_s"]
    grouped = members.groupBy("video_id", "merge_no").agg(
        F.count("*").alias("__n"), F.first("reason").alias("stitch_reason"),
        F.sort_array(F.flatten(F.collect_list("segments"))).alias("segments"),
        F.transform(F.sort_array(F.collect_list(F.struct(start.alias("s"), F.col("candidate_id")))), lambda x: x["candidate_id"]).alias("stitched_from"),
        F.max_by(
            F.struct(*rest), F.struct("master_score", "virality_score", "hook_score", (-start).alias("s"))
        ).alias("__lead"),
    )
    fine = grouped.where((F.col("__n") >= 2) & (_runtime(F.col("segments")) <= max_s + 30.0))
    merged = fine.select(
        "video_id", "merge_no", F.concat(F.lit("merged_"), F.array_join("stitched_from", "+")).alias("candidate_id"), "segments",
        *[F.col(f"__lead.{c}").alias(c) for c in rest], "stitched_from", "stitch_reason",
    )
    if fused is not None:
        over = [c for c in fused.columns if c not in ("video_id", "merge_no")]
        renamed = fused.withColumnsRenamed({c: f"__f_{c}" for c in over})
        merged = merged.join(renamed, ["video_id", "merge_no"], "left").withColumns({
            c: F.coalesce(blank_to_null(F.col(f"__f_{c}")), F.col(c)) if c in rest else F.col(f"__f_{c}") for c in over
        }).drop(*[f"__f_{c}" for c in over])
    refresh = {
        "total_duration": round_to(_runtime(F.col("segments"))), "start_s": F.col("segments")[0]["start_s"],
        "end_s": F.element_at("segments", -1)["end_s"],
    }
    merged = merged.withColumns({c: e for c, e in refresh.items() if c in rest})
    consumed = fine.select("video_id", F.explode("stitched_from").alias("candidate_id"))
    kept = candidates.join(consumed, ["video_id", "candidate_id"], "left_anti")
    return kept.unionByName(merged.drop("merge_no"), allowMissingColumns=True)


# ---- plans ------------------------------------------------------------------------------------------------------


def plan_shape(candidates: DataFrame) -> DataFrame:
    """Plan columns that follow from one candidate row: merged parts, durations, titles, tags, texts."""
    have = set(candidates.columns)
    col = lambda c: blank_to_null(F.col(c)) if c in have else F.lit(None).cast("string")
    fixed = fix_segment_overlaps(F.col("segments"))
    parts = F.transform(fixed, lambda p: F.struct(
        p["start_s"].alias("start_s"), p["end_s"].alias("end_s"), round_to(p["end_s"] - p["start_s"]).alias("duration_s")
    ))
    rows = candidates.where(F.size("segments") > 0).withColumn("segments", parts)
    total = F.aggregate("segments", F.lit(0.0), lambda s, p: s + p["duration_s"])
    title = F.coalesce(col("youtube_title"), col("working_title"), col("title"), F.lit("Clip"))
    text = F.coalesce(col("description_text"), col("description"), F.lit(""))
    own_tags = F.col("hashtags") if "hashtags" in have else F.array().cast("array<string>")
    tag_text = tokens(F.coalesce(col("description_hashtags"), F.lit("")))
    tags = F.when(F.size(tag_text) > 0, tag_text).otherwise(F.coalesce(own_tags, F.array().cast("array<string>")))
    num = lambda c, d: F.coalesce(F.col(c).cast("double"), F.lit(d)) if c in have else F.lit(d)
    return rows.select(
        "video_id", "candidate_id", *(["ord"] if "ord" in have else []), title.alias("title"), "segments",
        round_to(total).alias("total_duration"), (F.size("segments") > 1).alias("is_concat"),
        num("hook_score", 5.0).alias("hook_score"), num("flow_score", 5.0).alias("flow_score"),
        num("virality_score", 5.0).alias("virality_score"), num("meaning_score", 5.0).alias("meaning_score"),
        num("completeness_score", 0.0).alias("completeness_score"), num("boundary_score", 0.0).alias("boundary_score"),
        num("master_score", 0.0).alias("master_score"),
        *[F.coalesce(col(c), F.lit("")).alias(c) for c in ("reason", "takeaway", "hook_text", "hook_phrase", "caption", "youtube_tags")],
        text.alias("description"), tags.alias("hashtags"), F.coalesce(col("takeaway"), col("caption"), F.lit("")).alias("social_caption"),
    )


def build_plan(candidates: DataFrame, segments: DataFrame, words: DataFrame) -> DataFrame:
    """Plan rows with the exact words they cover."""
    return word_exact_text(plan_shape(candidates), segments, words)


def select_top(
    plans: DataFrame, n: int, keys: Sequence[str] = ("video_id",), score: str = "master_score", tie: Sequence[str] = ("ord",),
    name: bool = True,
) -> DataFrame:
    """The ``n`` best per key, numbered from 1; equal scores go by ``tie``.

    A filter on ``row_number`` lets Spark cut every partition to the first n before and after the shuffle, so a huge
    key sends n rows per input partition and no more.
    """
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), *tie)
    ranked = plans.withColumn("clip_index", F.row_number().over(w)).where(F.col("clip_index") <= n)
    return ranked.withColumn("clip_name", F.format_string("clip_%02d", F.col("clip_index"))) if name else ranked


def validation_pool(plans: DataFrame, n: int, **kwargs) -> DataFrame:
    """The plans sent to review: some more than will be kept."""
    return select_top(plans, max(n + 5, int(n * 1.5)), **kwargs)


def adjust_amount(text: Column) -> Column:
    """STRUCT<side, delta> of ``start -2.5`` or ``end +1``; NULL when it names neither."""
    low = F.lower(text)
    side = F.regexp_extract(low, r"(start|end)\s*([+-]?\d*(?:\.\d+)?)", 1)
    delta = F.regexp_extract(low, r"(start|end)\s*([+-]?\d*(?:\.\d+)?)", 2).try_cast("double")
    return F.when((side != "") & delta.isNotNull(), F.struct(side.alias("side"), delta.alias("delta")))


def apply_decisions(
    plans: DataFrame, decisions: DataFrame, words: DataFrame, segments: DataFrame | None = None, large: bool | None = None
) -> DataFrame:
    """Keep, drop or adjust plans by review decisions (video_id, clip_name, decision, suggested_adjustment).

    No decision keeps a plan. A discard counts only when hook < 7 and meaning < 6. An adjusted edge moves by the
    given seconds and then to the nearest word edge, unless the part would fall under half a second.
    """
    asked = decisions.select(
        "video_id", "clip_name", F.lower("decision").alias("__d"), adjust_amount(F.coalesce("suggested_adjustment", F.lit(""))).alias("__a")
    )
    joined = plans.join(asked, ["video_id", "clip_name"], "left")
    weak = (F.col("hook_score") < 7.0) & (F.col("meaning_score") < 6.0)
    joined = joined.where(~(F.coalesce(F.col("__d") == "discard", F.lit(False)) & weak))
    first, last = F.col("segments")[0], F.element_at("segments", -1)
    move = (F.col("__d") == "adjust") & F.col("__a").isNotNull()
    raw = F.when(
        F.col("__a.side") == "start", F.greatest(F.lit(0.0), first["start_s"] + F.col("__a.delta"))
    ).otherwise(F.greatest(last["start_s"] + 0.1, last["end_s"] + F.col("__a.delta")))
    joined = joined.withColumn("__raw", F.when(move, raw))
    block_s = 3600.0 if block_if(large, words, ["video_id"], F.lit(0)) is not None else None
    snapped = None
    for side, edge in (("start", "start_s"), ("end", "end_s")):
        part = joined.where(F.col("__raw").isNotNull() & (F.col("__a.side") == side)).select("video_id", "clip_name", "__raw")
        edges = words.join(part.select("video_id").distinct(), "video_id", "left_semi").select(
            "video_id", F.col(edge).alias("__edge"), F.col(edge).alias("__hit")
        )
        near = asof_nearest(part, edges, ["video_id"], "__raw", "__edge", ["__hit"], ["clip_name"], block_s=block_s)
        near = near.select("video_id", "clip_name", "__hit")
        snapped = near if snapped is None else snapped.unionByName(near)
    joined = joined.join(snapped, ["video_id", "clip_name"], "left")
    at = F.coalesce("__hit", "__raw")
    start_ok = first["end_s"] - at >= 0.5
    end_ok = at - last["start_s"] >= 0.5
    new_start = round_to(F.when(start_ok, at).otherwise(F.col("__raw")))
    new_end = round_to(F.when(end_ok, at).otherwise(F.col("__raw")))
    part = lambda p, s, e: F.struct(s.alias("start_s"), e.alias("end_s"), round_to(e - s).alias("duration_s"))
    n = F.size("segments")
    moved = F.when(
        F.col("__raw").isNotNull() & (F.col("__a.side") == "start"),
        F.concat(F.array(part(first, new_start, first["end_s"])), F.slice("segments", F.lit(2), F.greatest(n, F.lit(1)))),
    ).when(
        F.col("__raw").isNotNull(), F.concat(F.slice("segments", F.lit(1), n - 1), F.array(part(last, last["start_s"], new_end)))
    ).otherwise(F.col("segments"))
    joined = joined.withColumn("segments", F.when(F.col("__d").isNotNull(), _refit(moved)).otherwise(F.col("segments")))
    changed = F.col("__raw").isNotNull()
    total = F.aggregate("segments", F.lit(0.0), lambda s, p: s + p["duration_s"])
    out = joined.withColumns({
        "adjusted": changed, "total_duration": F.when(F.col("__d").isNotNull(), round_to(total)).otherwise(F.col("total_duration")),
        "is_concat": F.size("segments") > 1,
    }).drop("__d", "__a", "__raw", "__hit")
    if segments is not None and "transcript_text" in plans.columns:
        redo = word_exact_text(out.where("adjusted").drop("transcript_text"), segments, words)
        out = out.where("not adjusted").unionByName(redo)
    return out


def _refit(segments: Column) -> Column:
    return F.transform(fix_segment_overlaps(segments), lambda p: F.struct(
        p["start_s"].alias("start_s"), p["end_s"].alias("end_s"), round_to(p["end_s"] - p["start_s"]).alias("duration_s")
    ))


def plan_fingerprint(plans: DataFrame, min_s: float, max_s: float, length: int = 12) -> DataFrame:
    """Short hash per video over the names and outer times of its plans and the duration settings."""
    two = lambda c: F.format_string("%.2f", c)
    line = F.concat(
        "clip_name", F.lit(":"), two(F.col("segments")[0]["start_s"]), F.lit("-"), two(F.element_at("segments", -1)["end_s"])
    )
    lines = F.transform(F.sort_array(F.collect_list(F.struct("clip_index", line.alias("l")))), lambda x: x["l"])
    text = F.concat(F.lit(f"d{int(min_s)}-{int(max_s)}|"), F.array_join(lines, "|"))
    return plans.groupBy("video_id").agg(F.substring(F.md5(text), 1, length).alias("fingerprint"))


def plan_summary(plans: DataFrame) -> DataFrame:
    """Per video: spans, seconds, parts and mean scores."""
    return plans.groupBy("video_id").agg(
        F.count("*").alias("n_clips"), round_to(F.sum("total_duration")).alias("total_s"),
        F.sum(F.size("segments")).alias("n_segments"), F.count_if("is_concat").alias("n_concat"),
        round_to(F.avg("hook_score")).alias("avg_hook"), round_to(F.avg("flow_score")).alias("avg_flow"),
        round_to(F.avg("virality_score")).alias("avg_virality"),
    )


def attach_resolved_spans(candidates: DataFrame, plans: DataFrame) -> DataFrame:
    """Resolved start and end next to each candidate, by id; taken anew on every run."""
    spans = plans.where((F.col("candidate_id") != "") & (F.size("segments") > 0)).select(
        "video_id", "candidate_id", F.col("segments")[0]["start_s"].alias("resolved_start"),
        F.element_at("segments", -1)["end_s"].alias("resolved_end"),
    )
    old = [c for c in ("resolved_start", "resolved_end") if c in candidates.columns]
    return candidates.drop(*old).join(spans, ["video_id", "candidate_id"], "left")
