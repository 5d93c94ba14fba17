"""Registered queries over candidates: scoring, duplicates, alignment, merging, decisions, selection."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.numbers import round_to
from ..functions.text import INCOMPLETE_ENDS, REFINED_WEAK_OPENERS, SOFT_OPENERS, WEAK_PLAN_OPENERS, tokens
from ..functions.times import minutes_text
from ..operators import align, candidates, selection, similarity, windows
from ..operators.intervals import islands
from ..operators.ordered import position, with_ordered
from ..operators.transcript import pseudo_words
from ..session import cut_lineage, cut_lineage_in_place
from ..sources.tables import (
    benchmark_anchors, conversation_segments, document_segments, document_words, event_spans, label_decisions, table,
)
from .select_clips import select_clips
from .sql import SEGMENTS, SPANS, WORDS, r3, stamp
from .transcript_queries import sql_list

ROW_BOUND = False  # the video of a document is one row
NO_ANCHORS = ("start_words", "start_frame", "end_words", "end_frame")


def one_part(start, end):
    return F.array(F.struct(
        start.alias("start_s"), end.alias("end_s"), *[F.lit(None).cast("string").alias(c) for c in NO_ANCHORS]
    ))


def q_candidate_duration(spark, d):
    out = candidates.span_durations(event_spans(spark, d), ["video_id"], ["start_s", "end_s", "candidate_id"])
    return out.select("video_id", round_to(F.col("duration_s")).alias("duration_s"), "n_spans")


def q_fix_segment_overlaps(spark, d):
    out = islands(event_spans(spark, d), ["video_id"], ["start_s", "end_s", "candidate_id"], strict=True)
    return out.select("video_id", round_to(F.col("start_s")).alias("start_s"), round_to(F.col("end_s")).alias("end_s"), "n_parts")


def q_dedupe_candidates(spark, d):
    kept = candidates.dedupe_candidates(event_spans(spark, d), ["video_id"], "score", ["candidate_id"])
    return kept.select("video_id", "candidate_id", "score")


def event_plans(spark, d):
    """Plans of up to three parts: the spans of a user in time order, three by three."""
    spans = event_spans(spark, d)
    placed = with_ordered(spans, ["video_id"], ["start_s", "candidate_id"], {"__i": position()})
    grouped = placed.groupBy("video_id", F.floor(F.col("__i") / 3).alias("ord")).agg(
        F.sort_array(F.collect_list(F.struct("start_s", "end_s"))).alias("segments"),
        F.max("score").alias("master_score"), F.min("candidate_id").alias("candidate_id"),
    )
    return grouped.withColumn("segments", candidates.fix_segment_overlaps(F.col("segments")))


def q_remove_overlaps(spark, d):
    kept = candidates.remove_overlaps(cut_lineage(event_plans(spark, d)), ["video_id"], ["ord"])
    return kept.select("video_id", "ord", "candidate_id", "master_score", F.size("segments").cast("bigint").alias("n_parts"))


def q_master_score(spark, d):
    s = event_spans(spark, d)
    return s.select("video_id", "candidate_id", candidates.master_score(F.col("length_s"), 20.0, 30.0, F.col("score")).alias("master_score"))


def q_align_phrases(spark, d):
    anchors = benchmark_anchors(spark, d).select("anchor_id", F.col("start_phrase").alias("phrase"), F.lit(None).cast("double").alias("hint_s"))
    out = align.align_phrases(anchors, document_words(spark, d), on=[], large=ROW_BOUND)
    return out.select("video_id", "anchor_id", "start_idx", "end_idx", "match_start", "match_end", round_to(F.col("ratio")).alias("ratio"))


def q_snap_end(spark, d):
    e = align.word_edges(document_words(spark, d), large=ROW_BOUND)
    return e.select("video_id", "word_idx", "snapped_end", "filler_start", "gap_start")


def slices(segs):
    s = windows.fixed_slices(segs, 30, 60, None)
    return s.select("video_id", "candidate_id", "start_s", "end_s", one_part(F.col("start_s"), F.col("end_s")).alias("segments"))


def q_word_exact_text(spark, d):
    segs = cut_lineage_in_place(document_segments(spark, d))
    out = candidates.word_exact_text(slices(segs), segs, pseudo_words(segs))
    return out.select("video_id", "candidate_id", "transcript_text")


def q_candidate_text(spark, d):
    segs = cut_lineage_in_place(document_segments(spark, d))
    out = candidates.candidate_text(slices(segs), segs, 1800)
    return out.select("video_id", "candidate_id", "evidence")


def q_context_lines(spark, d):
    segs = cut_lineage_in_place(document_segments(spark, d))
    out = candidates.context_lines(slices(segs), segs)
    return out.select("video_id", "candidate_id", "line_no", "seg_id", "selected")


def q_anchor_summary(spark, d):
    segs = cut_lineage_in_place(document_segments(spark, d))
    c = candidates.candidate_text(slices(segs), segs, None).withColumn("hook_text", F.col("evidence")).withColumn("reason", F.lit(""))
    return candidates.anchor_summary(c, segs)


def q_filter_and_score(spark, d):
    """Short spans of the documents lengthened to 30 seconds, scored, with evidence and repaired metadata."""
    segs = cut_lineage_in_place(document_segments(spark, d))
    short = windows.fixed_slices(segs, 10, 12, None).withColumns({
        "segments": one_part(F.col("start_s"), F.col("end_s")), "hashtags": F.array(F.lit("#Talk"), F.lit("talk!")), "caption": F.lit(""), "description": F.lit(""),
    })
    out = candidates.filter_and_score(short, segs, 30.0, 60.0, large=ROW_BOUND)
    return out.select(
        "video_id", "candidate_id", round_to(F.col("start_s")).alias("start_s"), round_to(F.col("end_s")).alias("end_s"),
        "total_duration", "master_score", "evidence", F.array_join("hashtags", " ").alias("tags"), "title",
    )


def q_refine_merge(spark, d):
    """Slices of the documents in batches of five, and answers to most of them: moved, some much longer, some twice, some without id."""
    segs = cut_lineage_in_place(document_segments(spark, d))
    flat = {n: F.lit(6.0) for n in candidates.SCORES}
    texts = {n: F.lit("") for n in ("title", "caption", "description")} | {"hashtags": F.array().cast("array<string>")}
    own = slices(segs).withColumns({"ord": F.substring("candidate_id", 6, 12).cast("bigint") - 1, "master_score": F.lit(36.0), **flat, **texts})
    o = F.col("ord")
    shape = lambda rows, cid, start, end, hook, n: rows.withColumns({
        "candidate_id": cid, "start_s": start, "end_s": end, "hook_score": hook, "batch": F.floor(o / 5), "ord": n,
    }).withColumn("segments", one_part(F.col("start_s"), F.col("end_s"))).drop("master_score")
    long_ = F.when(o % 6 == 2, 200.0).otherwise(0.0)
    moved = shape(own.where(o % 4 != 3), F.when(o % 5 != 0, F.col("candidate_id")), F.col("start_s") + 1.0, F.col("end_s") + 2.0 * (o % 3) + long_, 5.0 + o % 7, o)
    again = shape(own.where(o % 5 == 1), F.concat("candidate_id", F.lit("b")), F.col("start_s") + 4.0, F.col("end_s") + 3.0, 4.5 + o % 5, o + 1000000)
    out = candidates.refine_merge(own, moved.unionByName(again), segs, 8.0, 60.0, large=ROW_BOUND)
    return out.select("video_id", "batch", "candidate_id", "refined", round_to(F.col("start_s")).alias("start_s"), round_to(F.col("end_s")).alias("end_s"), "master_score")


def q_short_with_neighbours(spark, d):
    s = event_spans(spark, d)
    out = selection.neighbours(s.select("video_id", "candidate_id", "start_s", "end_s", "length_s")).where("length_s < 15")
    return out.select("video_id", "candidate_id", "prev_id", "next_id", round_to(F.col("gap_before_s")).alias("gap_before_s"), round_to(F.col("gap_after_s")).alias("gap_after_s"))


def _event_candidates(spark, d):
    s = event_spans(spark, d)
    return s.select(
        "video_id", F.col("candidate_id").cast("string").alias("candidate_id"), F.col("candidate_id").alias("ord"),
        one_part(F.col("start_s"), F.col("end_s")).alias("segments"), F.col("score").alias("master_score"),
        F.lit(0.0).alias("virality_score"), F.lit(0.0).alias("hook_score"), F.col("speaker").alias("title"),
    )


def _event_merges(spark, d):
    """A merge of each short span with the one after it."""
    s = event_spans(spark, d).select("video_id", "candidate_id", "start_s", "end_s", "length_s")
    near = selection.neighbours(s).where("length_s < 15 and next_id is not null")
    return near.select(
        "video_id", F.col("candidate_id").alias("merge_no"), F.array(F.col("candidate_id").cast("string"), F.col("next_id").cast("string")).alias("merge_ids"),
        F.lit("short").alias("reason"),
    )


def q_validate_merges(spark, d):
    return selection.validate_merges(cut_lineage(_event_merges(spark, d))).select("video_id", "merge_no", F.array_join("merge_ids", "+").alias("ids"))


def q_apply_merges(spark, d):
    merges = selection.validate_merges(cut_lineage(_event_merges(spark, d)))
    out = selection.apply_merges(_event_candidates(spark, d), merges, 60.0)
    return out.select(
        "video_id", "candidate_id", F.size("segments").cast("bigint").alias("n_parts"), "master_score", "title",
        round_to(F.col("segments")[0]["start_s"]).alias("start_s"),
    )


def _whole_plans(segs):
    """One plan per document over all of it, a part per minute, in the shape of a reviewed plan."""
    totals = windows.last_end(segs)
    end = round_to(F.col("total_s"))
    last = F.greatest(F.ceil(end / 60) - 1, F.lit(0)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(
        (k * 60.0).alias("start_s"), F.least(end, k * 60.0 + 60.0).alias("end_s"), round_to(F.least(end, k * 60.0 + 60.0) - k * 60.0).alias("duration_s"),
    ))
    return totals.select(
        "video_id", F.lit("clip_01").alias("clip_name"), F.lit(1).alias("clip_index"), F.concat(F.lit("w01_c"), F.col("video_id").cast("string")).alias("candidate_id"),
        parts.alias("segments"), end.alias("total_duration"), (last > 0).alias("is_concat"),
        (F.pmod("video_id", F.lit(9)) + 1).cast("double").alias("hook_score"), F.lit(5.0).alias("meaning_score"),
        F.lit(5.0).alias("flow_score"), F.lit(5.0).alias("virality_score"),
    )


def q_apply_decisions(spark, d):
    segs = document_segments(spark, d)
    decided = label_decisions(spark, d).withColumn("clip_name", F.lit("clip_01"))
    out = selection.apply_decisions(_whole_plans(segs), decided, pseudo_words(segs), large=ROW_BOUND)
    return out.select("video_id", "clip_name", "adjusted", "total_duration", F.col("segments")[0]["start_s"].alias("start_s"), F.element_at("segments", -1)["end_s"].alias("end_s"), F.size("segments").alias("n_parts"))


def q_plan_fingerprint(spark, d):
    return selection.plan_fingerprint(_whole_plans(document_segments(spark, d)), 30, 60)


def q_plan_summary(spark, d):
    return selection.plan_summary(_whole_plans(document_segments(spark, d)))


def q_select_top(spark, d):
    s = event_spans(spark, d).withColumnRenamed("candidate_id", "ord")
    return selection.select_top(s, 5, score="score").select("video_id", "ord", "score", "clip_index", "clip_name")


def q_select_top_volume(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return selection.select_top(li, 10, ("l_suppkey",), "l_extendedprice", ("l_orderkey", "l_linenumber"), name=False)


def q_clause_end_before(spark, d):
    segs = cut_lineage_in_place(document_segments(spark, d))
    ranges = slices(segs).select("video_id", F.col("candidate_id").alias("clip_id"), "start_s", "end_s")
    return align.clause_end_before(ranges, pseudo_words(segs)).select("video_id", "clip_id", round_to(F.col("clause_end")).alias("clause_end"))


def q_forward_trim(spark, d):
    segs = cut_lineage_in_place(document_segments(spark, d))
    plans = slices(segs).select("video_id", F.col("candidate_id").alias("clip_id"), "start_s", "end_s", (F.col("end_s") - F.col("start_s")).alias("total_s"))
    out = align.forward_trim_weak_start(plans, pseudo_words(segs), WEAK_PLAN_OPENERS, 30.0, large=ROW_BOUND)
    return out.select("video_id", "clip_id", "start_s")


def q_similarity_dedupe(spark, d):
    """Near-equal sentences of a document, whole texts; longer sentences count as better."""
    s = document_segments(spark, d).withColumn("key", similarity.text_key(F.col("text"), None)).withColumn("score", F.length("text").cast("double"))
    out = similarity.dedupe_by_similarity(s, ["video_id"], "key", "score", ["seg_id"])
    return out.select("video_id", "seg_id")


def ranked_candidates(segs, large=ROW_BOUND):
    """Candidates quoted from ranked windows: five words at each edge, frames as hints, scores from the window."""
    wins = windows.rank_windows(segs, large=large).groupBy("video_id", "start_idx", "end_idx", "start_s", "end_s").agg(F.max("score").alias("score"))
    starts = segs.select("video_id", F.col("seg_id").alias("start_idx"), F.col("text").alias("__st"), F.col("start_s").alias("__s0"), F.col("end_s").alias("__s1"))
    ends = segs.select("video_id", F.col("seg_id").alias("end_idx"), F.col("text").alias("__et"), F.col("start_s").alias("__e0"), F.col("end_s").alias("__e1"))
    both = wins.join(starts, ["video_id", "start_idx"]).join(ends, ["video_id", "end_idx"])
    frame = lambda a, b: F.concat(F.lit("["), minutes_text(F.col(a)), F.lit(" -> "), minutes_text(F.col(b)), F.lit("]"))
    t = tokens(F.col("__et"))
    part = F.struct(
        "start_s", "end_s", F.array_join(F.slice(tokens(F.col("__st")), 1, 5), " ").alias("start_words"), frame("__s0", "__s1").alias("start_frame"),
        F.array_join(F.slice(t, F.greatest(F.lit(1), F.size(t) - 4), 5), " ").alias("end_words"), frame("__e0", "__e1").alias("end_frame"),
    )
    length = F.col("end_s") - F.col("start_s")
    return both.select(
        "video_id", F.concat(F.lit("w"), F.col("start_idx").cast("string"), F.lit("_"), F.col("end_idx").cast("string")).alias("candidate_id"),
        F.col("start_idx").cast("bigint").alias("ord"), F.array(part).alias("segments"), F.col("__st").alias("title"),
        *[(F.col("score") + i).alias(s) for i, s in enumerate(candidates.SCORES)],
        candidates.master_score(length, 30.0, 60.0, F.col("score") * 6 + 15.0).alias("master_score"),
    )


def q_select_clips(spark, d):
    """Documents end to end: ranked windows quoted as phrases, resolved to word times, merged, de-duplicated, reviewed, best five."""
    segs = cut_lineage_in_place(document_segments(spark, d))
    words = pseudo_words(segs)  # made again from the sentences, which are kept; words are many times their size
    cands = cut_lineage_in_place(ranked_candidates(segs))
    near = selection.find_short_with_neighbours(cands, 30.0, large=ROW_BOUND).where("next_id is not null and gap_after_s < 10")
    merges = near.select(
        "video_id", F.row_number().over(Window.partitionBy("video_id").orderBy("start_s", "candidate_id")).cast("bigint").alias("merge_no"), F.array("candidate_id", "next_id").alias("merge_ids"), F.lit("short").alias("reason")
    )
    decided = label_decisions(spark, d).withColumn("clip_name", F.lit("clip_01"))
    out = select_clips(cands, segs, words, 5, 60.0, merges, decided, large=ROW_BOUND)
    return out.select(
        "video_id", "clip_name", "candidate_id", "title", "total_duration", "is_concat", "master_score",
        F.col("segments")[0]["start_s"].alias("start_s"), F.element_at("segments", -1)["end_s"].alias("end_s"), "transcript_text",
    )


def q_resolve_boundaries(spark, d):
    """Benchmark passages looked for in every document by their first and last words."""
    a = benchmark_anchors(spark, d)
    parts = a.select(
        F.col("anchor_id").alias("candidate_id"), F.lit(0).alias("part"), F.col("start_phrase").alias("start_words"), F.col("end_phrase").alias("end_words"),
        F.lit(None).cast("double").alias("start_hint"), F.lit(None).cast("double").alias("end_hint"),
    )
    return align.resolve_boundaries(parts, document_words(spark, d), on=[], large=ROW_BOUND)


def q_apply_compression(spark, d):
    """Spans over 45 seconds come back halved, as time text."""
    s = _event_candidates(spark, d)
    p = F.col("segments")[0]
    half = (p["start_s"] + p["end_s"]) / 2
    back = s.where(F.pmod("ord", F.lit(2)) == 0).select(
        "video_id", "candidate_id", F.array(F.struct(p["start_s"].cast("string").alias("start"), F.concat(half.cast("string"), F.lit("s")).alias("end"))).alias("segments"), F.lit(" cut ").alias("compression_note"),
    )
    out = candidates.apply_compression(s, back, 45.0)
    return out.select("video_id", "candidate_id", round_to(F.col("start_s")).alias("start_s"), round_to(F.col("end_s")).alias("end_s"), "compression_note")


def q_attach_resolved_spans(spark, d):
    c = _event_candidates(spark, d)
    plans = c.where("master_score > 50")
    out = selection.attach_resolved_spans(c.select("video_id", "candidate_id"), plans)
    return out.select("video_id", "candidate_id", round_to(F.col("resolved_start")).alias("resolved_start"), round_to(F.col("resolved_end")).alias("resolved_end"))


def q_flag_needs_verification(spark, d):
    """Sentences of the documents as refined one-part candidates."""
    segs = document_segments(spark, d)
    part = F.struct("start_s", "end_s", F.col("text").alias("start_words"), *[F.lit(None).cast("string").alias(c) for c in NO_ANCHORS[1:]])
    refined = segs.select("video_id", F.col("seg_id").cast("string").alias("candidate_id"), F.array(part).alias("segments"))
    again = refined.where(F.pmod(F.col("candidate_id").cast("int"), F.lit(5)) == 0).withColumn("segments", F.concat("segments", "segments"))
    out = candidates.flag_needs_verification(refined, again, 5.0)
    return out.select("video_id", "candidate_id", "verify_reason")


def q_accept_verified(spark, d):
    """The same sentences; every second comes back five seconds longer with plain opening words."""
    segs = cut_lineage_in_place(document_segments(spark, d).select("video_id", "seg_id", "start_s", "end_s", "text"))
    rest = [F.lit(None).cast("string").alias(c) for c in NO_ANCHORS[1:]]
    refined = segs.select("video_id", F.col("seg_id").cast("string").alias("candidate_id"), F.array(F.struct("start_s", "end_s", F.col("text").alias("start_words"), *rest)).alias("segments"))
    again = refined.where(F.pmod(F.col("candidate_id").cast("int"), F.lit(5)) == 0).withColumn("segments", F.concat("segments", "segments"))
    longer = F.struct("start_s", (F.col("end_s") + 5.0).alias("end_s"), F.lit("Plain words open").alias("start_words"), *rest)
    verified = segs.where("seg_id % 2 = 0").select("video_id", F.col("seg_id").cast("string").alias("candidate_id"), F.array(longer).alias("segments"))
    out = candidates.accept_verified(refined, again, verified, 5.0)
    return out.select("video_id", "candidate_id", "verify_reason", round_to(F.col("segments")[0]["end_s"]).alias("end_s"))


def q_merge_window_outputs(spark, d):
    """Windows of the documents, each with a candidate per fourth segment, gathered per document."""
    segs = cut_lineage_in_place(document_segments(spark, d))
    wins = windows.transcript_windows(segs, 120.0, 24.0)
    parsed = wins.groupBy("video_id", "window").agg(
        F.sort_array(F.collect_list(F.when(F.pmod("seg_id", F.lit(4)) == 0, F.struct("seg_id")))).alias("candidates"), F.expr("cast(array() as array<string>)").alias("chapters"), F.lit("s").alias("summary"),
    )
    bounds = windows.window_bounds(windows.last_end(segs), 120.0, 24.0)
    out, _, _ = candidates.merge_window_outputs(parsed, bounds)
    return out.select("video_id", "candidate_id", F.col("source_window").cast("bigint").alias("source_window"), "source_window_start", "source_window_end", F.col("candidate.seg_id").alias("seg_id"))


QUERIES = {
    "apply_compression": q_apply_compression,
    "attach_resolved_spans": q_attach_resolved_spans,
    "flag_needs_verification": q_flag_needs_verification,
    "accept_verified": q_accept_verified,
    "merge_window_outputs": q_merge_window_outputs,
    "select_clips": q_select_clips,
    "candidate_duration": q_candidate_duration,
    "fix_segment_overlaps": q_fix_segment_overlaps,
    "dedupe_candidates": q_dedupe_candidates,
    "remove_overlaps": q_remove_overlaps,
    "master_score": q_master_score,
    "align_phrases": q_align_phrases,
    "resolve_boundaries": q_resolve_boundaries,
    "snap_end": q_snap_end,
    "word_exact_text": q_word_exact_text,
    "candidate_text": q_candidate_text,
    "context_lines": q_context_lines,
    "anchor_summary": q_anchor_summary,
    "filter_and_score": q_filter_and_score,
    "refine_merge": q_refine_merge,
    "short_with_neighbours": q_short_with_neighbours,
    "validate_merges": q_validate_merges,
    "apply_merges": q_apply_merges,
    "apply_decisions": q_apply_decisions,
    "plan_fingerprint": q_plan_fingerprint,
    "plan_summary": q_plan_summary,
    "select_top": q_select_top,
    "select_top_volume": q_select_top_volume,
    "clause_end_before": q_clause_end_before,
    "forward_trim_weak_start": q_forward_trim,
    "similarity_dedupe": q_similarity_dedupe,
}


def runs_sql(gap: str, test: str) -> str:
    return f"""
 reach AS (SELECT *, max(end_s) OVER (PARTITION BY video_id ORDER BY start_s, end_s, candidate_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM span),
 flag AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_s {test} reach + {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY start_s, end_s, candidate_id) AS run FROM reach),
 runs AS (SELECT video_id, run, min(start_s) AS start_s, max(end_s) AS end_s, count(*) AS n_parts FROM flag GROUP BY 1, 2)"""


def greedy_sql(source: str, order: str, state: str, blank: str, conflict: str) -> str:
    """Best-first selection as a recursive walk: one step per rank, the kept rows as a list."""
    return f"""
 ranked AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY {order}) AS rn FROM {source}),
 walk(video_id, rn, kept) AS (
   SELECT DISTINCT video_id, CAST(0 AS BIGINT), {blank} FROM ranked
   UNION ALL
   SELECT w.video_id, w.rn + 1, CASE WHEN len(list_filter(w.kept, lambda k: {conflict})) = 0 THEN list_append(w.kept, {state}) ELSE w.kept END
   FROM walk w JOIN ranked x ON x.video_id = w.video_id AND x.rn = w.rn + 1),
 final AS (SELECT video_id, arg_max(kept, rn) AS kept FROM walk GROUP BY 1),
 keptrow AS (SELECT video_id, u.k FROM final, unnest(kept) AS u(k))"""


DEDUPE_CONFLICT = "greatest(0, least(k.e, x.end_s) - greatest(k.s, x.start_s)) / least(greatest(0.1, k.e - k.s), greatest(0.1, x.end_s - x.start_s)) > 0.5"
SLICES = """
 tl AS (SELECT video_id, arg_max(end_s, seg_id) AS total FROM seg GROUP BY video_id),
 slot AS (SELECT video_id, u.k, u.k * 48.0::DOUBLE AS a, least(total, u.k * 48.0::DOUBLE + 60.0) AS b FROM tl, unnest(range(0, CAST(ceil(total / 48.0) AS BIGINT))) AS u(k)),
 slice AS (SELECT video_id, 'w01_c' || CASE WHEN k < 9 THEN '0' ELSE '' END || CAST(k + 1 AS VARCHAR) AS candidate_id, a AS start_s, b AS end_s FROM slot WHERE b - a >= 10)"""
NEAR_EDGES = """
 sn AS (SELECT c.video_id, c.candidate_id,
   coalesce((SELECT arg_min(start_s, {d: abs(seg.start_s - c.start_s), t: seg.start_s}) FROM seg WHERE seg.video_id = c.video_id AND abs(seg.start_s - c.start_s) < 3.0), c.start_s) AS a,
   coalesce((SELECT arg_min(end_s, {d: abs(seg.end_s - c.end_s), t: seg.end_s}) FROM seg WHERE seg.video_id = c.video_id AND abs(seg.end_s - c.end_s) < 3.0), c.end_s) AS b FROM slice c)"""
FRAME = f"'[' || {stamp('g.start_s')} || ' -> ' || {stamp('g.end_s')} || ']'"
SNAP = f"""
 w1 AS (SELECT *, lead(start_s) OVER v AS ns, clean IN ({sql_list(sorted(set(INCOMPLETE_ENDS)))}) AS dangling FROM wrd WINDOW v AS (PARTITION BY video_id ORDER BY word_idx)),
 w2 AS (SELECT *, NOT dangling AND (regexp_matches(word, '[.!?]$') OR coalesce(ns - end_s >= 0.45, false)) AS ok, coalesce(ns - end_s > 2.5, false) AS sil FROM w1),
 w3 AS (SELECT *,
   min(CASE WHEN ok THEN word_idx END) OVER (PARTITION BY video_id ORDER BY word_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nx,
   max(CASE WHEN ok THEN word_idx END) OVER (PARTITION BY video_id ORDER BY word_idx) AS pv,
   min(CASE WHEN sil THEN word_idx END) OVER (PARTITION BY video_id ORDER BY word_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS sx,
   greatest(coalesce(max(CASE WHEN NOT dangling THEN word_idx END) OVER (PARTITION BY video_id ORDER BY word_idx), 0), word_idx - 8, 0) AS solid
  FROM w2),
 snap AS (SELECT w.*, CASE WHEN NOT w.dangling THEN w.end_s
     WHEN n.word_idx IS NOT NULL AND (w.sx IS NULL OR w.nx <= w.sx) AND n.start_s <= w.end_s + 12.0 THEN n.end_s
     WHEN p.word_idx IS NOT NULL AND p.end_s >= w.end_s - 6.0 THEN p.end_s
     ELSE z.end_s END AS snapped_end
   FROM w3 w LEFT JOIN wrd n ON n.video_id = w.video_id AND n.word_idx = w.nx LEFT JOIN wrd p ON p.video_id = w.video_id AND p.word_idx = w.pv
   JOIN wrd z ON z.video_id = w.video_id AND z.word_idx = w.solid)"""
MERGES = """
 nb AS (SELECT *, lead(candidate_id) OVER (PARTITION BY video_id ORDER BY start_s, candidate_id) AS next_id FROM span),
 prop AS (SELECT video_id, candidate_id, next_id FROM nb WHERE length_s < 15 AND next_id IS NOT NULL),
""" + greedy_sql(
    "prop", "candidate_id", "{a: x.candidate_id, b: x.next_id}", "CAST([] AS STRUCT(a BIGINT, b BIGINT)[])",
    "k.a = x.candidate_id OR k.a = x.next_id OR k.b = x.candidate_id OR k.b = x.next_id",
)
FILLERS = sql_list(align.LEADING_FILLERS)

ORACLES = {
    "candidate_duration": f"WITH {SPANS},{runs_sql('0.5', '>')} SELECT video_id, {r3('sum(greatest(0.0, end_s - start_s))')} AS duration_s, count(*) AS n_spans FROM runs GROUP BY 1",
    "fix_segment_overlaps": f"WITH {SPANS},{runs_sql('0', '>=')} SELECT video_id, {r3('start_s')} AS start_s, {r3('end_s')} AS end_s, n_parts FROM runs",
    "dedupe_candidates": f"WITH RECURSIVE {SPANS},{greedy_sql('span', 'score DESC, candidate_id', '{s: x.start_s, e: x.end_s, id: x.candidate_id, v: x.score}', 'CAST([] AS STRUCT(s DOUBLE, e DOUBLE, id BIGINT, v DOUBLE)[])', DEDUPE_CONFLICT)} SELECT video_id, k.id AS candidate_id, k.v AS score FROM keptrow",
    "remove_overlaps": f"""WITH RECURSIVE {SPANS},
 pl AS (SELECT video_id, (row_number() OVER (PARTITION BY video_id ORDER BY start_s, candidate_id) - 1) // 3 AS ord, start_s, end_s, score, candidate_id FROM span),
 re AS (SELECT *, max(end_s) OVER (PARTITION BY video_id, ord ORDER BY start_s, end_s, candidate_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM pl),
 fl AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_s >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY video_id, ord ORDER BY start_s, end_s, candidate_id) AS run FROM re),
 pt AS (SELECT video_id, ord, run, min(start_s) AS s, max(end_s) AS e FROM fl GROUP BY 1, 2, 3),
 pp AS (SELECT video_id, ord, list({{s: s, e: e}}) AS p, sum(e - s) AS dur FROM pt GROUP BY 1, 2),
 plans AS (SELECT pp.*, q.ms, q.cid FROM pp JOIN (SELECT video_id, ord, max(score) AS ms, min(candidate_id) AS cid FROM pl GROUP BY 1, 2) q USING (video_id, ord)),
 {greedy_sql('plans', 'ms DESC, ord', '{p: x.p, d: x.dur, o: x.ord, m: x.ms, c: x.cid}', 'CAST([] AS STRUCT(p STRUCT(s DOUBLE, e DOUBLE)[], d DOUBLE, o BIGINT, m DOUBLE, c BIGINT)[])',
   'list_sum(list_transform(k.p, lambda a: list_sum(list_transform(x.p, lambda b: greatest(0.0, least(a.e, b.e) - greatest(a.s, b.s)))))) / least(k.d, x.dur) > 0.5')}
 SELECT video_id, k.o AS ord, k.c AS candidate_id, k.m AS master_score, len(k.p) AS n_parts FROM keptrow""",
    "master_score": f"WITH {SPANS} SELECT video_id, candidate_id, {r3('score - CASE WHEN length_s < 20.0 THEN (20.0::DOUBLE - length_s) * 0.15::DOUBLE WHEN length_s > 30.0 AND length_s - 30.0 <= 60.0 THEN (length_s - 30.0::DOUBLE) * 0.05::DOUBLE WHEN length_s > 30.0 THEN 3.0::DOUBLE + (length_s - 30.0::DOUBLE - 60.0::DOUBLE) * 0.15::DOUBLE ELSE 0.0 END')} AS master_score FROM span",
    "align_phrases": f"""WITH {WORDS},
 tok0 AS (SELECT item_id, u.t, u.i FROM benchmark, unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')[1:5]) WITH ORDINALITY AS u(t, i)),
 tok1 AS (SELECT item_id, regexp_replace(lower(t), '[^\\p{{L}}\\p{{N}}_]', '', 'g') AS c, i FROM tok0),
 tok AS (SELECT item_id, c, row_number() OVER (PARTITION BY item_id ORDER BY i) - 1 AS pos, count(*) OVER (PARTITION BY item_id) AS n FROM tok1 WHERE c <> ''),
 len AS (SELECT video_id, count(*) AS words FROM wrd GROUP BY 1),
 hit AS (SELECT w.video_id, item_id, w.word_idx - pos AS s, any_value(n) AS n, count(*) AS m FROM tok JOIN wrd w ON w.clean = tok.c GROUP BY 1, 2, 3),
 good AS (SELECT hit.*, m::DOUBLE / n AS ratio FROM hit JOIN len USING (video_id) WHERE s >= 0 AND s + n <= words AND m::DOUBLE / n >= 0.7::DOUBLE),
 best AS (SELECT *, row_number() OVER (PARTITION BY video_id, item_id ORDER BY ratio DESC, s) AS r FROM good)
 SELECT b.video_id, item_id AS anchor_id, CAST(s AS INTEGER) AS start_idx, CAST(s + n - 1 AS INTEGER) AS end_idx, a.start_s AS match_start, z.end_s AS match_end, {r3('ratio')} AS ratio
 FROM best b JOIN wrd a ON a.video_id = b.video_id AND a.word_idx = s JOIN wrd z ON z.video_id = b.video_id AND z.word_idx = s + n - 1 WHERE r = 1""",
    "snap_end": f"""WITH {WORDS},{SNAP},
 lead4 AS (SELECT *, CASE WHEN clean IN ({FILLERS}) AND ns IS NOT NULL THEN 1 ELSE 0 END AS fil, coalesce(ns - end_s > 0.8, false) AS dead FROM snap),
 ahead AS (SELECT *, least(word_idx + 4, min(CASE WHEN fil = 0 THEN word_idx END) OVER (PARTITION BY video_id ORDER BY word_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS stop,
   min(CASE WHEN dead THEN word_idx END) OVER (PARTITION BY video_id ORDER BY word_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS gx FROM lead4)
 SELECT a.video_id, a.word_idx, a.snapped_end, f.start_s AS filler_start, g.start_s AS gap_start
 FROM ahead a JOIN wrd f ON f.video_id = a.video_id AND f.word_idx = a.stop LEFT JOIN wrd g ON g.video_id = a.video_id AND g.word_idx = a.gx + 1""",
    "word_exact_text": f"""WITH {WORDS},{SLICES},
 hit AS (SELECT DISTINCT c.video_id, c.candidate_id, w.word_idx, w.word FROM slice c
   JOIN seg ON seg.video_id = c.video_id AND seg.end_s > c.start_s AND seg.start_s < c.end_s
   JOIN wrd w ON w.video_id = seg.video_id AND w.seg_id = seg.seg_id AND (w.start_s + w.end_s) / 2 BETWEEN c.start_s - 0.05::DOUBLE AND c.end_s + 0.05::DOUBLE)
 SELECT c.video_id, c.candidate_id, coalesce(string_agg(word, ' ' ORDER BY word_idx), '') AS transcript_text FROM slice c LEFT JOIN hit USING (video_id, candidate_id) GROUP BY 1, 2""",
    "refine_merge": f"""WITH RECURSIVE {SEGMENTS},{SLICES}, og AS (SELECT *, CAST(substr(candidate_id, 6) AS BIGINT) - 1 AS o FROM slice),
 sz AS (SELECT video_id, o // 5 AS batch, count(*) AS n, any_value(candidate_id) AS sole FROM og GROUP BY 1, 2),
 an AS (SELECT video_id, o // 5 AS batch, o AS ord, CASE WHEN o % 5 <> 0 THEN candidate_id END AS cid, start_s + 1.0 AS start_s, end_s + 2.0 * (o % 3) + CASE WHEN o % 6 = 2 THEN 200.0 ELSE 0.0 END AS end_s, 35.0::DOUBLE + o % 7 AS q FROM og WHERE o % 4 <> 3
  UNION ALL SELECT video_id, o // 5, o + 1000000, candidate_id || 'b', start_s + 4.0, end_s + 3.0, 34.5::DOUBLE + o % 5 FROM og WHERE o % 5 = 1),
 aw AS (SELECT an.video_id * 100000 + batch AS video_id, ord, CASE WHEN n = 1 THEN coalesce(cid, sole) ELSE cid END AS cid, start_s, end_s, q FROM an JOIN sz USING (video_id, batch)),{greedy_sql('aw', 'q DESC, ord', '{s: x.start_s, e: x.end_s, id: x.cid, v: x.q}', 'CAST([] AS STRUCT(s DOUBLE, e DOUBLE, id VARCHAR, v DOUBLE)[])', DEDUPE_CONFLICT)},
 ok AS (SELECT video_id // 100000 AS video_id, video_id % 100000 AS batch, k.id AS candidate_id, k.s AS s, k.e AS e, k.v AS q, k.e - k.s AS dur FROM keptrow WHERE k.e > k.s AND k.e - k.s <= 150)
 SELECT video_id, batch, candidate_id, true AS refined, {r3('s')} AS start_s, {r3('e')} AS end_s, {r3('q - CASE WHEN dur < 8 THEN (8.0 - dur) * 0.15::DOUBLE WHEN dur > 60 AND dur - 60 <= 60 THEN (dur - 60) * 0.05::DOUBLE WHEN dur > 60 THEN 3.0 + (dur - 120) * 0.15::DOUBLE ELSE 0 END')} AS master_score FROM ok
 UNION ALL SELECT video_id, o // 5, candidate_id, false, {r3('start_s')}, {r3('end_s')}, 36.0::DOUBLE FROM og WHERE NOT EXISTS (SELECT 1 FROM ok WHERE ok.video_id = og.video_id AND ok.batch = og.o // 5 AND ok.candidate_id = og.candidate_id)""",
    "plan_fingerprint": f"""WITH {SEGMENTS}, pl AS (SELECT video_id, (CAST(round({r3('arg_max(end_s, seg_id)')} * 1000) AS BIGINT) + 5) // 10 AS c FROM seg GROUP BY 1)
 SELECT video_id, substr(md5('d30-60|clip_01:0.00-' || CAST(c // 100 AS VARCHAR) || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0')), 1, 12) AS fingerprint FROM pl""",
    "anchor_summary": f"""WITH {SEGMENTS},{SLICES},{NEAR_EDGES},
 ev AS (SELECT sn.video_id, sn.candidate_id, list_filter(regexp_split_to_array(coalesce(string_agg(text, ' ' ORDER BY seg_id), ''), '\\s+'), lambda w: w <> '') AS t
   FROM sn LEFT JOIN seg ON seg.video_id = sn.video_id AND seg.end_s > a AND seg.start_s < b AND a < b GROUP BY 1, 2),
 fr AS (SELECT c.video_id, c.candidate_id,
   max_by({FRAME}, CASE WHEN c.start_s BETWEEN g.start_s - 0.5 AND greatest(g.end_s, g.start_s + 0.5) THEN seg_id END) AS f0, max_by({FRAME}, CASE WHEN c.end_s BETWEEN g.start_s - 0.5 AND greatest(g.end_s, g.start_s + 0.5) THEN seg_id END) AS f1
   FROM slice c JOIN seg g ON g.video_id = c.video_id AND (c.start_s BETWEEN g.start_s - 0.5 AND greatest(g.end_s, g.start_s + 0.5) OR c.end_s BETWEEN g.start_s - 0.5 AND greatest(g.end_s, g.start_s + 0.5)) GROUP BY 1, 2)
 SELECT video_id, candidate_id, array_to_string(t[1:5], ' ') AS start_anchor, array_to_string(t[greatest(1, len(t) - 4):len(t)], ' ') AS end_anchor,
  coalesce(f0, '[00:00.00 -> 00:00.00]') AS start_frame, coalesce(f1, '[00:00.00 -> 00:00.00]') AS end_frame FROM ev LEFT JOIN fr USING (video_id, candidate_id)""",
    "candidate_text": f"""WITH {SEGMENTS},{SLICES},{NEAR_EDGES}
 SELECT sn.video_id, sn.candidate_id, substr(trim(regexp_replace(coalesce(string_agg(text, ' ' ORDER BY seg_id), ''), '\\s+', ' ', 'g')), 1, 1800) AS evidence
 FROM sn LEFT JOIN seg ON seg.video_id = sn.video_id AND seg.end_s > a AND seg.start_s < b AND a < b GROUP BY 1, 2""",
    "context_lines": f"""WITH {SEGMENTS},{SLICES},
 hit AS (SELECT c.video_id, c.candidate_id, seg_id, seg.start_s >= c.start_s - 0.1::DOUBLE AND seg.end_s <= c.end_s + 0.1::DOUBLE AS selected, n + 6 AS n
   FROM slice c JOIN seg ON seg.video_id = c.video_id AND seg.end_s >= greatest(0.0, c.start_s - 15.0) AND seg.start_s <= c.end_s + 40.0),
 num AS (SELECT *, row_number() OVER v - 1 AS line_no, sum(n) OVER v AS used FROM hit WINDOW v AS (PARTITION BY video_id, candidate_id ORDER BY seg_id))
 SELECT video_id, candidate_id, line_no, seg_id, selected FROM num WHERE line_no < 100 AND used <= 2000""",
    "short_with_neighbours": f"""WITH {SPANS},
 nb AS (SELECT *, lag(candidate_id) OVER v AS prev_id, lead(candidate_id) OVER v AS next_id, start_s - lag(end_s) OVER v AS g0, lead(start_s) OVER v - end_s AS g1 FROM span WINDOW v AS (PARTITION BY video_id ORDER BY start_s, candidate_id))
 SELECT video_id, candidate_id, prev_id, next_id, {r3('g0')} AS gap_before_s, {r3('g1')} AS gap_after_s FROM nb WHERE length_s < 15""",
    "validate_merges": f"""WITH RECURSIVE {SPANS},{MERGES} SELECT video_id, k.a AS merge_no, CAST(k.a AS VARCHAR) || '+' || CAST(k.b AS VARCHAR) AS ids FROM keptrow""",
    "apply_merges": f"""WITH RECURSIVE {SPANS},{MERGES},
 mem AS (SELECT video_id, k.a AS no, unnest([k.a, k.b]) AS candidate_id FROM keptrow),
 full_ AS (SELECT m.no, s.* FROM mem m JOIN span s USING (video_id, candidate_id)),
 mg AS (SELECT video_id, no, sum(end_s - start_s) AS total, count(*) AS n FROM full_ GROUP BY 1, 2 HAVING sum(end_s - start_s) <= 90.0),
 fm AS (SELECT f.*, row_number() OVER (PARTITION BY f.video_id, f.no ORDER BY score DESC, start_s) AS best, row_number() OVER (PARTITION BY f.video_id, f.no ORDER BY start_s, CAST(candidate_id AS VARCHAR)) AS r FROM full_ f JOIN mg USING (video_id, no))
 SELECT video_id, 'merged_' || string_agg(CAST(candidate_id AS VARCHAR), '+' ORDER BY r) AS candidate_id, count(*) AS n_parts, max(CASE WHEN best = 1 THEN score END) AS master_score, max(CASE WHEN best = 1 THEN speaker END) AS title, {r3('min(start_s)')} AS start_s FROM fm GROUP BY video_id, no
 UNION ALL SELECT video_id, CAST(candidate_id AS VARCHAR), 1, score, speaker, {r3('start_s')} FROM span s WHERE NOT EXISTS (SELECT 1 FROM fm WHERE fm.video_id = s.video_id AND fm.candidate_id = s.candidate_id)""",
    "apply_decisions": f"""WITH {WORDS},
 pl AS (SELECT *, least(e, 60.0) AS e1, CAST(greatest(1, ceil(e / 60.0)) AS INTEGER) AS n FROM (SELECT video_id, {r3('arg_max(end_s, seg_id)')} AS e FROM seg GROUP BY 1)),
 dec AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'discard' WHEN quality = 0 THEN 'adjust' ELSE 'keep' END AS d FROM labels),
 j AS (SELECT pl.*, dec.d, (SELECT arg_min(w.start_s, {{g: abs(w.start_s - 2.0), t: w.start_s}}) FROM wrd w WHERE w.video_id = pl.video_id) AS hit FROM pl LEFT JOIN dec ON dec.doc_id = pl.video_id),
 k AS (SELECT *, CASE WHEN d = 'adjust' THEN CASE WHEN e1 - hit >= 0.5 THEN {r3('hit')} ELSE 2.0 END ELSE 0.0 END AS s FROM j WHERE NOT (coalesce(d, 'keep') = 'discard' AND video_id % 9 + 1 < 7))
 SELECT video_id, 'clip_01' AS clip_name, coalesce(d = 'adjust', false) AS adjusted, {r3('e - s')} AS total_duration, s AS start_s, e AS end_s, n AS n_parts FROM k""",
    "plan_summary": f"""WITH {SEGMENTS}, pl AS (SELECT *, CAST(greatest(1, ceil(e / 60.0)) AS BIGINT) AS n FROM (SELECT video_id, {r3('arg_max(end_s, seg_id)')} AS e FROM seg GROUP BY 1))
 SELECT video_id, CAST(1 AS BIGINT) AS n_clips, {r3('e')} AS total_s, n AS n_segments, CAST(n > 1 AS BIGINT) AS n_concat, (video_id % 9 + 1)::DOUBLE AS avg_hook, 5.0::DOUBLE AS avg_flow, 5.0::DOUBLE AS avg_virality FROM pl""",
    "select_top": f"""WITH {SPANS}, r AS (SELECT video_id, candidate_id AS ord, score, CAST(row_number() OVER (PARTITION BY video_id ORDER BY score DESC, candidate_id) AS INTEGER) AS clip_index FROM span)
 SELECT *, 'clip_' || lpad(CAST(clip_index AS VARCHAR), 2, '0') AS clip_name FROM r WHERE clip_index <= 5""",
    "select_top_volume": """SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, clip_index FROM (SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice,
 CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS INTEGER) AS clip_index FROM lineitem) WHERE clip_index <= 10""",
    "clause_end_before": f"""WITH {WORDS},{SLICES}
 SELECT c.video_id, c.candidate_id AS clip_id, {r3("coalesce(max(w.end_s), any_value(c.end_s))")} AS clause_end
 FROM slice c LEFT JOIN wrd w ON w.video_id = c.video_id AND w.end_s > c.start_s AND w.end_s <= c.end_s AND regexp_matches(w.word, '[.,;:—–-]$') GROUP BY 1, 2""",
    "forward_trim_weak_start": f"""WITH {WORDS},{SLICES},
 wk AS (SELECT *, lower(regexp_replace(word, '^[^A-Za-z0-9]+', '')) IN ({sql_list(WEAK_PLAN_OPENERS)}) AS weak, lead(start_s) OVER v AS ns, lag(start_s) OVER v AS ps FROM wrd WINDOW v AS (PARTITION BY video_id ORDER BY word_idx)),
 sp AS MATERIALIZED (SELECT *, min(CASE WHEN NOT weak OR ns IS NULL THEN word_idx END) OVER (PARTITION BY video_id ORDER BY word_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS stop FROM wk),
 opn AS (SELECT c.video_id, c.candidate_id, c.start_s AS p, c.end_s - c.start_s AS tot, min(word_idx) AS i FROM slice c JOIN sp w ON w.video_id = c.video_id AND w.start_s + 0.05::DOUBLE >= c.start_s GROUP BY 1, 2, 3, 4),
 step AS (SELECT a.video_id, a.candidate_id, w.word_idx AS j, w.start_s AS s, a.tot - (w.start_s - CASE WHEN w.word_idx = a.i + 1 THEN a.p ELSE w.ps END) < 24.0::DOUBLE AS short
   FROM opn a JOIN sp f ON f.video_id = a.video_id AND f.word_idx = a.i AND f.stop > a.i JOIN sp w ON w.video_id = a.video_id AND w.word_idx BETWEEN a.i + 1 AND f.stop),
 bd AS (SELECT *, min(CASE WHEN short THEN j END) OVER (PARTITION BY video_id, candidate_id) AS bad FROM step),
 mv AS (SELECT video_id, candidate_id, arg_max(s, j) AS s FROM bd WHERE bad IS NULL OR j < bad GROUP BY 1, 2)
 SELECT c.video_id, c.candidate_id AS clip_id, {r3('coalesce(mv.s, c.start_s)')} AS start_s FROM slice c LEFT JOIN mv USING (video_id, candidate_id)""",
    "apply_compression": f"""WITH {SPANS} SELECT video_id, CAST(candidate_id AS VARCHAR) AS candidate_id, {r3('start_s')} AS start_s, CASE WHEN candidate_id % 2 = 0 AND end_s - start_s > 45.0 THEN {r3('(start_s + end_s) / 2')} ELSE {r3('end_s')} END AS end_s,
 CASE WHEN candidate_id % 2 = 0 AND end_s - start_s > 45.0 THEN 'cut' END AS compression_note FROM span""",
    "attach_resolved_spans": f"WITH {SPANS} SELECT video_id, CAST(candidate_id AS VARCHAR) AS candidate_id, CASE WHEN score > 50 THEN {r3('start_s')} END AS resolved_start, CASE WHEN score > 50 THEN {r3('end_s')} END AS resolved_end FROM span",
    "accept_verified": f"""WITH {SEGMENTS}, o AS (SELECT *, lower(regexp_replace(text, '^[^A-Za-z0-9]+', '')) AS low FROM seg),
 fl AS (SELECT video_id, CAST(seg_id AS VARCHAR) AS candidate_id, CASE WHEN seg_id % 5 = 0 THEN 'fewer_parts' WHEN end_s - start_s < 3.5 THEN 'too_short' WHEN regexp_extract(low, '^\\S+') IN ({sql_list(REFINED_WEAK_OPENERS)}) THEN 'weak_opener'
  WHEN {" OR ".join("starts_with(low, '" + p.replace("'", "''") + "')" for p in SOFT_OPENERS)} THEN 'soft_opener' END AS verify_reason, seg_id, end_s FROM o)
 SELECT video_id, candidate_id, verify_reason, {r3('CASE WHEN verify_reason IS NOT NULL AND seg_id % 2 = 0 AND seg_id % 5 <> 0 THEN end_s + 5.0::DOUBLE ELSE end_s END')} AS end_s FROM fl""",
    "flag_needs_verification": f"""WITH {SEGMENTS}, o AS (SELECT *, lower(regexp_replace(text, '^[^A-Za-z0-9]+', '')) AS low FROM seg)
 SELECT video_id, CAST(seg_id AS VARCHAR) AS candidate_id, CASE WHEN seg_id % 5 = 0 THEN 'fewer_parts' WHEN end_s - start_s < 3.5 THEN 'too_short' WHEN regexp_extract(low, '^\\S+') IN ({sql_list(REFINED_WEAK_OPENERS)}) THEN 'weak_opener'
  WHEN {" OR ".join("starts_with(low, '" + p.replace("'", "''") + "')" for p in SOFT_OPENERS)} THEN 'soft_opener' END AS verify_reason FROM o""",
    "merge_window_outputs": f"""WITH {SEGMENTS}, tl AS (SELECT video_id, arg_max(end_s, seg_id) AS total FROM seg GROUP BY 1),
 win AS (SELECT video_id, k, k * 96.0::DOUBLE AS a, least(total, k * 96.0::DOUBLE + 120.0) AS b, total FROM tl, unnest(range(0, CASE WHEN total <= 120.0 THEN 1 ELSE CAST(ceil((total - 120.0) / 96.0) AS BIGINT) + 1 END)) AS u(k)),
 h AS (SELECT win.*, seg_id, row_number() OVER (PARTITION BY win.video_id, k ORDER BY seg_id) AS i FROM win JOIN seg ON seg.video_id = win.video_id AND seg_id % 4 = 0 AND (total <= 120.0 OR (end_s > a AND start_s < b)))
 SELECT video_id, 'w' || CASE WHEN k < 9 THEN '0' ELSE '' END || CAST(k + 1 AS VARCHAR) || '_c' || CASE WHEN i < 10 THEN '0' ELSE '' END || CAST(i AS VARCHAR) AS candidate_id, k + 1 AS source_window, {r3('a')} AS source_window_start, {r3('b')} AS source_window_end, seg_id FROM h""",
}
