"""Scene cuts, sampling, template clustering and classification from detector outputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import bhattacharyya, cosine, hamming_bits, round_to
from .greedy import greedy_select
from .hashes import nearest_hashes
from .intervals import interval_join
from .ordered import block_if, lag, lead, position, row_block, sum_before, time_block, with_ordered
from .scan import follow

CUT_GAP_S = 0.35
HASH_LIMIT = 12
SAME_HASH = 4
SAME_CROP_PX = 24.0
WINDOW_RADIUS_S = 2.0
VOTE_MARGIN = 0.35


def merge_cuts(cuts: DataFrame, gap_s: float = CUT_GAP_S, fallback: Sequence[str] = ("fallback",), bounds: DataFrame | None = None, large: bool | None = None) -> DataFrame:
    """Union of the detectors' cuts, each more than ``gap_s`` after the last one kept.

    Fallback detectors count only for videos where the others found nothing. A pause over ``gap_s`` between cuts
    always starts anew; inside a run of closer cuts each points at the next that may be kept, and the chain from the first is followed. bounds (video_id, start_s, end_s)
    add the first and last boundary.
    """
    main = cuts.where(~F.col("detector").isin(*fallback))
    spare = cuts.where(F.col("detector").isin(*fallback)).join(main.select("video_id").distinct(), "video_id", "left_anti")
    times = main.unionByName(spare).select("video_id", "t_s").distinct()
    block = block_if(large, times, ["video_id"], time_block("t_s"))
    near = with_ordered(times, ["video_id"], ["t_s"], {"__prev": lag(F.col("t_s"))}, block)
    fresh = F.when(F.col("__prev").isNull() | (F.col("t_s") - F.col("__prev") > gap_s), 1).otherwise(0)
    marked = with_ordered(near.withColumn("__new", fresh), ["video_id"], ["t_s"], {"__upto": sum_before(F.col("__new"))}, block)
    run = ["video_id", "__run"]
    # most runs are one cut; the chains of the others are followed from cut to cut
    in_run = marked.select("video_id", (F.col("__upto") + F.col("__new")).alias("__run"), "t_s", "__new")
    # neighbours in a run are at most a gap apart, so the next cut, if any, is less than two gaps away; near the gap itself times are compared exactly
    gap_us = int(round(gap_s * 1e6))
    here = Window.partitionBy(*run).orderBy(F.round(F.col("t_s") * 1e6).cast("bigint"))
    beside = F.filter(F.collect_list("t_s").over(here.rangeBetween(gap_us - 3, gap_us + 3)), lambda x: x - F.col("t_s") > gap_s)
    onward = F.min("t_s").over(here.rangeBetween(gap_us + 4, 2 * gap_us + 8))
    links = in_run.withColumn("next", F.coalesce(F.array_min(beside), onward)).where("next is not null")
    starts = in_run.where("__new = 1").select(*run, F.col("t_s").alias("at"))
    out = follow(starts, links.withColumnRenamed("t_s", "at"), run).select("video_id", F.col("at").alias("t_s"))
    if bounds is None:
        return out
    inside = out.join(bounds.select("video_id", "start_s", "end_s"), "video_id").where(F.col("t_s") - F.col("start_s") > gap_s).select("video_id", "t_s")
    edges = bounds.select("video_id", F.explode(F.array("start_s", "end_s")).alias("t_s"))
    return inside.unionByName(edges).distinct()


def scenes_from_cuts(boundaries: DataFrame, large: bool | None = None) -> DataFrame:
    """Scenes between neighbouring boundaries, numbered from 0."""
    block = block_if(large, boundaries, ["video_id"], time_block("t_s"))
    near = with_ordered(boundaries, ["video_id"], ["t_s"], {"end_s": lead(F.col("t_s")), "scene": position()}, block)
    return near.where("end_s is not null").select("video_id", "scene", F.col("t_s").alias("start_s"), "end_s")


def refine_cut(cuts: DataFrame, frame_diffs: DataFrame, radius_s: float = 0.3) -> DataFrame:
    """Move each cut to the frame of the strongest change around it; without frames it stays.

    frame_diffs (video_id, t_s, mad, hist_diff). Of equal scores the earliest frame.
    """
    # the bounds are rounded, so they are a little wider than the distance that decides
    slack = F.lit(1e-9) * (F.abs("cut_s") + radius_s)
    probe = cuts.select("video_id", F.col("t_s").alias("cut_s")).distinct().withColumns({
        "__lo": F.col("cut_s") - radius_s - slack, "__hi": F.col("cut_s") + radius_s + slack,
    })
    score = F.col("mad") * (0.5 + 0.5 * F.col("hist_diff"))
    frames = frame_diffs.select("video_id", F.col("t_s").alias("__f"), F.col("t_s").alias("__f2"), score.alias("__score"))
    near = interval_join(probe, frames, ["video_id"], ("__lo", "__hi"), ("__f", "__f2"), max(5.0, radius_s), closed=True).where(F.abs(F.col("__f") - F.col("cut_s")) <= radius_s)
    best = near.groupBy("video_id", "cut_s").agg(
        F.max_by("__f", F.struct("__score", -F.col("__f"))).alias("__best")
    )
    return probe.select("video_id", "cut_s").join(best, ["video_id", "cut_s"], "left").withColumn(
        "refined_s", round_to(F.coalesce("__best", "cut_s"), 4)
    ).drop("__best")


def scene_of(points: DataFrame, scenes: DataFrame, point: str = "t_s", bucket_s: float = 60.0) -> DataFrame:
    """Scene with start <= t < end; the end of the last scene belongs to it."""
    last = scenes.groupBy("video_id").agg(F.max("end_s").alias("__last"))
    spans = scenes.join(last, "video_id").select(
        "video_id", "scene", F.col("start_s").alias("__s"),
        F.when(F.col("end_s") == F.col("__last"), F.col("end_s") + 1e-3).otherwise(F.col("end_s")).alias("__e"),
    )
    probe = points.withColumn("__t2", F.col(point))
    hit = interval_join(probe, spans, ["video_id"], (point, "__t2"), ("__s", "__e"), bucket_s, closed=True)
    return hit.where((F.col("__s") <= F.col(point)) & (F.col(point) < F.col("__e"))).drop("__s", "__e", "__t2")


def sample_times(start: Column, end: Column, stride: Column) -> Column:
    """Every ``stride`` seconds from start, and the end itself."""
    n = F.greatest(F.lit(0), F.ceil((end - start - 1e-6) / stride) - 1).cast("int")
    inner = F.transform(F.sequence(F.lit(0), n), lambda k: start + k * stride)
    closed = F.when(F.abs(F.element_at(inner, -1) - end) > 1e-6, F.concat(inner, F.array(end))).otherwise(inner)
    return F.when(end <= start, F.array(start)).otherwise(closed)


def cut_probe_times(start: Column, end: Column, fps: Column) -> Column:
    """1 and 4 frames before a scene's start and 2 and 6 after it, inside the media and the scene."""
    f = F.lit(1.0) / F.greatest(F.lit(1.0), fps)
    before = F.filter(F.array(start - f, start - 4 * f), lambda t: t >= 0)
    after = F.filter(F.array(start + 2 * f, start + 6 * f), lambda t: t < end)
    both = F.concat(before, after)
    return F.when(F.size(both) > 0, both).otherwise(F.array(start + F.least(F.lit(0.3), F.greatest(F.lit(0.0), (end - start) * 0.25))))


def window_probe_times(start: Column, end: Column, n: int = 3) -> Column:
    """Evenly spaced probes inside a span: 25, 50 and 75 % for three."""
    at = F.array(*[round_to(start + (end - start) * (i / (n + 1)), 4) for i in range(1, n + 1)])
    return F.when(end > start, F.sort_array(F.array_distinct(at))).otherwise(F.array().cast("array<double>"))


def medoid_hashes(frames: DataFrame) -> DataFrame:
    """Per scene the hash with the smallest total distance to the scene's others, the first of equals.

    frames (video_id, scene, frame_no, phash BIGINT): the handful of frames sampled for a scene. A scene without any
    hash has the hash NULL.
    """
    seen = F.filter(F.sort_array(F.collect_list(F.struct("frame_no", "phash"))), lambda x: x["phash"].isNotNull())
    scenes = frames.groupBy("video_id", "scene").agg(F.transform(seen, lambda x: x["phash"]).alias("__h"))
    total = F.transform("__h", lambda a, i: F.struct(
        F.aggregate("__h", F.lit(0), lambda s, b: s + hamming_bits(a, b)).alias("d"), i.alias("i"), a.alias("h")
    ))
    return scenes.select("video_id", "scene", F.array_min(total)["h"].alias("phash"))


def cluster_scenes(scenes: DataFrame, limit: int = HASH_LIMIT, small_group: int = 5000) -> DataFrame:
    """Template of each scene: the first leader closer than ``limit``; a scene without one leads.

    scenes (video_id, scene, phash BIGINT). Templates are numbered in order of their leader. A scene without hash
    leads none and takes template 0. Two hashes that differ in fewer than ``limit`` bits agree on one of ``limit``
    bands of the 64 bits, so only scenes that share a band are compared.
    """
    hashed = scenes.where(F.col("phash").isNotNull())
    bands = hash_bands(F.col("phash"), limit)
    led = greedy_select(
        hashed, ["video_id"], ["scene"], ["scene"], ["phash"], lambda k, x: hamming_bits(k["phash"], x["phash"]) < limit, bands, small_group
    )
    numbered = with_ordered(led, ["video_id"], ["scene"], {"template_id": position()})
    leaders = numbered.select("video_id", "template_id", F.col("phash").alias("__h"), F.explode(bands).alias("__band"))
    near = hashed.withColumn("__band", F.explode(bands)).join(leaders, ["video_id", "__band"])
    hit = near.where(hamming_bits(F.col("phash"), F.col("__h")) < limit).groupBy("video_id", "scene").agg(F.min("template_id").alias("template_id"))
    return scenes.select("video_id", "scene").join(hit, ["video_id", "scene"], "left").withColumn("template_id", F.coalesce("template_id", F.lit(0).cast("bigint")))


def hash_bands(phash: Column, n: int) -> Column:
    """The 64 bits of a hash cut into ``n`` bands, each as one number that names the band too."""
    edges = [k * 64 // n for k in range(n + 1)]
    return F.array(*[
        F.shiftrightunsigned(F.shiftleft(phash, a), 64 - (b - a)) * F.lit(n) + F.lit(k) if n > 1 else F.lit(0).cast("bigint")
        for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))
    ])


def prune_templates(templates: DataFrame, small_group: int = 5000) -> DataFrame:
    """Drop templates whose hash and crop nearly equal a kept one; canonical ones come first, then by id.

    templates (video_id, template_id, canonical BOOLEAN, phash BIGINT, crop_x, crop_y).
    """
    ranked = templates.withColumn("__first", F.when(F.col("canonical"), 0).otherwise(1))

    def same(k, x):
        return (
            (hamming_bits(k["phash"], x["phash"]) <= SAME_HASH)
            & (F.abs(k["crop_x"] - x["crop_x"]) <= SAME_CROP_PX) & (F.abs(k["crop_y"] - x["crop_y"]) <= SAME_CROP_PX)
        )

    # crops within 24 px share a 24 px cell or a neighbouring one
    x, y = F.floor(F.col("crop_x") / SAME_CROP_PX), F.floor(F.col("crop_y") / SAME_CROP_PX)
    cells = F.array(*[F.xxhash64(x + dx, y + dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    return greedy_select(ranked, ["video_id"], ["__first", "template_id"], ["template_id"], ["phash", "crop_x", "crop_y"], same, cells, small_group).drop("__first")


def remap_scenes(assigned: DataFrame, templates: DataFrame, active: DataFrame) -> DataFrame:
    """Scenes of removed templates go to the remaining template with the nearest hash, the first of equals.

    assigned (video_id, scene, template_id); templates carry phash; active (video_id, template_id, ord). Nearest hashes are found by
    ``nearest_hashes``. A removed template without hash, and a scene of no known template, go to the first remaining one; a remaining
    template without hash is nearest to none; where nothing remains, scenes keep their template.
    """
    hashes = templates.select("video_id", "template_id", "phash")
    gone = hashes.join(active.select("video_id", "template_id"), ["video_id", "template_id"], "left_anti")
    left = active.join(hashes, ["video_id", "template_id"]).select("video_id", F.col("template_id").alias("id"), "ord", "phash")
    near = nearest_hashes(gone, left, ["video_id"]).select("video_id", "phash", F.col("id").alias("__to"))
    first = active.groupBy("video_id").agg(F.min_by("template_id", "ord").alias("__first"))
    moved = gone.join(near, ["video_id", "phash"], "left").select("video_id", "template_id", "__to")
    stay = active.select("video_id", "template_id", F.col("template_id").alias("__to"))
    out = assigned.join(moved.unionByName(stay), ["video_id", "template_id"], "left").join(first, "video_id", "left")
    return out.select("video_id", "scene", F.coalesce("__to", "__first", "template_id").alias("template_id"))


# ---- classification ---------------------------------------------------------------------------------------------


def exposure_score(mean: Column, std: Column) -> Column:
    one = F.lit(1.0)
    return one - F.least(one, F.abs(mean - 128.0) / 128.0) * 0.65 - F.least(one, F.abs(std - 60.0) / 60.0) * 0.35


def _unit(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def _slot_distance(slots: Column, faces: Column, width: Column, height: Column) -> Column:
    """Mean distance of slots and faces paired from left to right, scaled to 0..1; 1 when either is missing."""
    n = F.least(F.size(slots), F.size(faces))
    dist = F.aggregate(
        F.sequence(F.lit(1), n), F.lit(0.0),
        lambda s, i: s + F.hypot(
            F.element_at(slots, i)["cx_norm"] - F.element_at(faces, i)["cx"] / F.greatest(F.lit(1.0), width),
            F.element_at(slots, i)["cy_norm"] - F.element_at(faces, i)["cy"] / F.greatest(F.lit(1.0), height),
        ),
    )
    return F.when(n > 0, F.least(F.lit(1.0), dist / n * 2.5)).otherwise(F.lit(1.0))


def _best(items: Column, others: Column, score) -> Column:
    """Largest score over all pairs, NULL without a pair."""
    return F.array_max(F.flatten(F.transform(items, lambda a: F.transform(others, lambda b: score(a, b)))))


def probe_scores(probes: DataFrame, templates: DataFrame) -> DataFrame:
    """Score of each template of the video on each probe.

    probes (video_id, seg_index, t_s, phash, sharpness, mean, std, width, height, faces ARRAY<STRUCT<cx, cy,
    embedding, shirt_hist>>, proto); templates (video_id, template_id, phash, n_faces, slots ARRAY<STRUCT<cx_norm,
    cy_norm, embedding, shirt_hist>>). Videos have few templates, so the join multiplies probes by a handful.
    """
    joined = probes.join(
        templates.select("video_id", "template_id", F.col("phash").alias("__th"), "n_faces", F.sort_array("slots").alias("slots")), "video_id"
    ).withColumn("faces", F.sort_array(F.coalesce("faces", F.expr("cast(array() as array<struct<cx:double,cy:double,embedding:array<float>,shirt_hist:array<float>>>)"))))
    count = F.size("faces")
    expected = F.greatest(F.lit(1), F.when(F.col("n_faces") > 0, F.col("n_faces")).when(F.size("slots") > 0, F.size("slots")).otherwise(1))
    hash_d = hamming_bits(F.col("phash"), F.col("__th")) / 64.0
    geom = _slot_distance(F.col("slots"), F.col("faces"), F.col("width"), F.col("height"))
    count_d = F.when((count == 0) & (F.col("n_faces") <= 0), F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.abs(count - expected) / expected))
    exp = exposure_score(F.col("mean"), F.col("std"))
    quality = 0.45 * _unit(F.col("sharpness") / 600.0) + 0.35 * exp + 0.20 * _unit(count / 2.0)
    staged = joined.withColumns({"__geom": geom, "__count": count_d, "__exp": exp, "__quality": quality})
    raw_a = (
        0.30 * (1.0 - hash_d) + 0.20 * (1.0 - F.col("__geom")) + 0.15 * (1.0 - F.col("__count"))
        + 0.15 * _unit(F.col("sharpness") / 800.0) + 0.10 * F.col("__exp")
        + 0.10 * (1.0 - F.least(F.lit(1.0), 0.5 * F.col("__geom") + 0.5 * F.col("__count")))
    )
    stage_a = _unit(raw_a * (0.5 + 0.5 * F.col("__quality")))
    embedded = F.filter("faces", lambda f: f["embedding"].isNotNull())
    slot_embeds = F.filter("slots", lambda s: s["embedding"].isNotNull())
    by_slot = _best(embedded, slot_embeds, lambda f, s: cosine(f["embedding"], s["embedding"]))
    by_proto = F.when(F.col("proto").isNotNull(), F.array_max(F.transform(embedded, lambda f: cosine(f["embedding"], F.col("proto"))))) if "proto" in probes.columns else F.lit(None).cast("double")
    shirt = _best(
        F.filter("faces", lambda f: f["shirt_hist"].isNotNull()), F.filter("slots", lambda s: s["shirt_hist"].isNotNull()),
        lambda f, s: 1.0 - bhattacharyya(f["shirt_hist"], s["shirt_hist"]),
    )
    span = lambda c: (F.array_max(F.transform("faces", lambda f: f[c])) + 1).cast("bigint").cast("double")
    slot_match = F.when(F.size("slots") > 0, 1.0 - _slot_distance(F.col("slots"), F.col("faces"), span("cx"), span("cy"))).otherwise(F.lit(0.0))
    zero = F.lit(0.0)
    stage_b = F.when(count > 0, _unit(
        0.50 * F.greatest(zero, F.coalesce(by_slot, zero), F.coalesce(by_proto, zero)) + 0.25 * F.greatest(zero, F.coalesce(shirt, zero)) + 0.25 * F.greatest(zero, slot_match)
    )).otherwise(zero)
    return staged.select(
        "video_id", "seg_index", "t_s", "template_id", count.alias("n_found"), stage_a.alias("stage_a"), stage_b.alias("stage_b")
    )


def classify_windows(segments: DataFrame, scores: DataFrame, radius_s: float = WINDOW_RADIUS_S, default: DataFrame | None = None) -> DataFrame:
    """Template of each segment by time-weighted votes of its probes, with confidence and the hidden-cut flag.

    segments (video_id, seg_index, start_s, end_s); scores from ``probe_scores``; default (video_id, seg_index,
    template_id) is what an unsure segment keeps.
    """
    mid = segments.select("video_id", "seg_index", ((F.col("start_s") + F.col("end_s")) / 2.0).alias("__mid"))
    combined = 0.72 * F.col("stage_a") + 0.28 * F.col("stage_b")
    weight = F.greatest(F.lit(0.15), 1.0 - F.least(F.lit(1.0), F.abs(F.col("t_s") - F.col("__mid")) / radius_s))
    seen = scores.join(mid, ["video_id", "seg_index"]).withColumns({"__c": F.when(F.col("stage_a") > 0, combined), "__w": weight})
    key = ["video_id", "seg_index"]
    votes = seen.groupBy(*key, "template_id").agg(
        F.coalesce(F.sum(F.col("__c") * F.col("__w")), F.lit(0.0)).alias("vote"), F.coalesce(F.max("__c"), F.lit(0.0)).alias("best"), F.coalesce(F.avg("__c"), F.lit(0.0)).alias("stability")
    )
    faces = seen.groupBy(*key, "t_s").agg(F.max("n_found").alias("__n")).groupBy(*key).agg(
        F.percentile("__n", F.lit(0.5)).alias("__med"), F.avg(F.when(F.col("__n") > 0, 1.0).otherwise(0.0)).alias("__share")
    )
    order = Window.partitionBy(*key).orderBy(F.col("vote").desc(), F.col("best").desc(), "template_id")
    whole = Window.partitionBy(*key)
    ranked = votes.withColumns({
        "__r": F.row_number().over(order), "__second": F.coalesce(F.lead("vote").over(order), F.lit(0.0)), "__all": F.sum("vote").over(whole),
    })
    maps = votes.groupBy(*key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("template_id", "best")))).alias("scores"))
    top = ranked.where("__r = 1").join(faces, key).join(maps, key)
    conf = _unit(F.col("vote") / F.greatest(F.lit(1e-6), F.col("__all")))
    hidden = (
        (F.col("vote") - F.col("__second") < VOTE_MARGIN) | (conf < 0.28) | (F.col("stability") < 0.25) | ((F.col("__share") < 0.25) & (F.col("__med") <= 0.5))
    )
    out = top.select(
        *key, "template_id", F.when(F.col("__med") >= 1.0, _unit(conf + 0.10)).otherwise(conf).alias("confidence"), hidden.alias("hidden"), "scores"
    )
    if default is None:
        return out
    kept = default.select(*key, F.col("template_id").alias("__default"))
    sure = F.col("hidden") | (F.col("confidence") >= 0.28)
    return out.join(kept, key, "left").withColumn("template_id", F.when(sure, F.col("template_id")).otherwise(F.coalesce("__default", "template_id"))).drop("__default")


# ---- segment edges ----------------------------------------------------------------------------------------------


def split_hidden_cuts(
    segments: DataFrame, probes: DataFrame, frame_diffs: DataFrame | None = None, min_segment_s: float = 4.0, threshold: float = 0.30,
    min_piece_s: float = 0.20, min_probes: int = 4,
) -> DataFrame:
    """Split segments where continuity flips between probes.

    segments (video_id, seg_index, start_s, end_s, speaker); probes (video_id, seg_index, t_s, continuity). A flip cuts
    at the midpoint, moved to the strongest frame change when ``frame_diffs`` is given; short pieces go.
    """
    key = ["video_id", "seg_index"]
    long_ = segments.where(F.col("end_s") - F.col("start_s") >= min_segment_s)
    enough = probes.groupBy(*key).agg(F.count("*").alias("__n")).where(F.col("__n") >= min_probes).select(*key)
    order = Window.partitionBy(*key).orderBy("t_s")
    tag = F.when(F.col("continuity") >= threshold, 1).otherwise(0)
    flips = probes.join(enough, key, "left_semi").withColumn("__tag", tag).withColumns({
        "__pt": F.lag("__tag").over(order), "__pp": F.lag("t_s").over(order),
    }).where("__pt is not null and __pt <> __tag").withColumn("t_s", (F.col("__pp") + F.col("t_s")) / 2.0)
    points = flips.select(*key, "t_s")
    if frame_diffs is not None:
        moved = refine_cut(points, frame_diffs, 0.75).withColumnRenamed("cut_s", "t_s")
        points = points.join(moved, ["video_id", "t_s"], "left").select(*key, F.coalesce("refined_s", "t_s").alias("t_s"))
    points = points.withColumn("t_s", round_to(F.col("t_s"), 4)).join(long_.select(*key, "start_s", "end_s"), key).where("t_s > start_s and t_s < end_s")
    lists = points.groupBy(*key).agg(F.sort_array(F.collect_set("t_s")).alias("__pts"))
    joined = segments.join(lists, key, "left")
    edges = F.concat(F.array("start_s"), F.coalesce("__pts", F.array().cast("array<double>")), F.array("end_s"))
    rest = [c for c in segments.columns if c not in ("start_s", "end_s")]
    pieces = joined.withColumn("__e", edges).select(
        *rest, F.col("__pts").isNotNull().alias("__cut"), F.posexplode(F.slice("__e", F.lit(1), F.size("__e") - 1)).alias("piece", "start_s"), "__e"
    ).withColumn("end_s", F.get("__e", F.col("piece") + 1))
    return pieces.where(~F.col("__cut") | (F.col("end_s") - F.col("start_s") >= min_piece_s)).select(*rest, "piece", "start_s", "end_s")


def trim_empty_edges(
    segments: DataFrame, face_counts: DataFrame, fps: float = 25.0, max_frames: int = 3, max_s: float = 0.12, large: bool | None = None
) -> DataFrame:
    """Take empty frames off both edges of each segment and map source times to output times.

    face_counts (video_id, frame BIGINT, faces INT), frame = round(t * fps). An unknown count ends the walk. The
    trim is undone when no more than 0.15 s would remain.
    """
    step = 1.0 / max(1.0, fps)
    n = max(1, min(max_frames, int(round(max_s * max(1.0, fps)))))
    key = ["video_id", "seg_index"]
    offs = segments.select(*key, "start_s", "end_s", F.explode(F.array(F.lit("s"), F.lit("e"))).alias("side")).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("off")
    )
    at = F.when(F.col("side") == "s", F.col("start_s") + F.col("off") * step).otherwise(F.col("end_s") - (F.col("off") + 1) * step)
    offs = offs.withColumn("__t", at)
    offs = offs.withColumns({
        "__in": F.when(F.col("side") == "s", F.col("__t") < F.col("end_s")).otherwise(F.col("__t") > F.col("start_s")),
        "frame": F.rint(F.col("__t") * fps).cast("bigint"),
    })
    seen = offs.join(face_counts.select("video_id", "frame", "faces"), ["video_id", "frame"], "left")
    stop = F.when(~F.col("__in") | F.coalesce(F.col("faces") != 0, F.lit(True)), F.col("off"))
    runs = seen.groupBy(*key).agg(*[
        F.coalesce(F.min(F.when(F.col("side") == s, stop)), F.lit(n)).alias(name) for s, name in (("s", "__sf"), ("e", "__ef"))
    ])
    joined = segments.join(runs, key)
    rs, re_ = F.col("start_s") + F.col("__sf") * step, F.col("end_s") - F.col("__ef") * step
    ok = re_ - rs > 0.15
    out = joined.withColumns({
        "render_start": F.when(ok, rs).otherwise(F.col("start_s")), "render_end": F.when(ok, re_).otherwise(F.col("end_s")),
    }).withColumns({
        "start_trim": F.greatest(F.lit(0.0), F.col("render_start") - F.col("start_s")), "end_trim": F.greatest(F.lit(0.0), F.col("end_s") - F.col("render_end")),
        "__len": F.greatest(F.lit(0.0), F.col("render_end") - F.col("render_start")),
    })
    block = block_if(large, segments, ["video_id"], row_block("seg_index"))
    placed = with_ordered(out, ["video_id"], ["seg_index"], {"output_start": sum_before(F.col("__len"))}, block)
    return placed.withColumn("output_end", F.col("output_start") + F.col("__len")).drop("__sf", "__ef", "__len")


def pad_segments(segments: DataFrame, fps: float = 25.0, before: int = 3, after: int = 2) -> DataFrame:
    """A few frames before and after each segment, inside [low_s, high_s] where those columns exist."""
    low = F.col("low_s") if "low_s" in segments.columns else F.lit(0.0)
    start = F.greatest(low, F.col("start_s") - before / fps)
    end = F.col("end_s") + after / fps
    end = F.least(F.col("high_s"), end) if "high_s" in segments.columns else end
    return segments.withColumns({"start_s": start, "end_s": end})
