"""Speaker timelines and face slots: who is on screen, who speaks, and which label belongs to which face."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import cosine, iou, unit
from ..session import cut_lineage
from .greedy import greedy_select
from .intervals import as_of, asof_nearest, interval_join
from .ordered import block_if, time_block

# Similarity and layout thresholds, crop shape.
EMBED_SIM = 0.45
SLOT_GAP = 0.15
WIDE_SPREAD = 0.40
WIDE_CROP_SHARE = 0.60
NOSE_ROOM = 0.08
MAX_NOSE = 0.15
HEAD_ROOM = 0.45
MAX_SLOTS = 4
UNKNOWN = "UNKNOWN"


# ---- timelines --------------------------------------------------------------------------------------------------


def slice_timeline(turns: DataFrame, ranges: DataFrame, min_s: float = 0.0, bucket_s: float = 30.0) -> DataFrame:
    """Turns cut to each range (video_id, range_id, r_start, r_end); pieces no longer than ``min_s`` go."""
    hit = interval_join(turns, ranges, ["video_id"], ("start_s", "end_s"), ("r_start", "r_end"), bucket_s)
    return hit.withColumns({
        "start_s": F.greatest("start_s", "r_start"), "end_s": F.least("end_s", "r_end"),
    }).where(F.col("end_s") - F.col("start_s") > min_s).drop("r_start", "r_end")


def base_segments(turns: DataFrame, scenes: DataFrame, ranges: DataFrame, mode: str | None = None) -> DataFrame:
    """Segments to plan: scenes when ``mode`` is continuous or a video has no wide layout, else turns of one or all speakers.

    ranges carry ``has_wide``. Turns are cut to the range and must last more than 0.15 s.
    """
    cols = ["video_id", "range_id", "start_s", "end_s", "speaker"]
    scene_cut = slice_timeline(scenes.select("video_id", "start_s", "end_s", F.lit(UNKNOWN).alias("speaker")), ranges.drop("has_wide"))
    if mode == "continuous":
        return scene_cut.select(*cols)
    plain = ranges.where("not has_wide").select("video_id", "range_id")
    wide = ranges.where("has_wide").drop("has_wide")
    spoken = slice_timeline(turns.where(F.col("speaker") == mode) if mode else turns, wide, 0.15)
    return scene_cut.join(plain, ["video_id", "range_id"], "left_semi").select(*cols).unionByName(spoken.select(*cols))


def active_speaker_at(
    points: DataFrame, turns: DataFrame, point: str = "t_s", point_id: Sequence[str] = ("point_id",), large: bool | None = None
) -> DataFrame:
    """Speaker at each point: the last turn that starts by then if it still runs, else the turn with the nearest edge.

    Before the first turn it is the first speaker; without any turn UNKNOWN. Two ordered passes, no join of points
    with all turns of a video.
    """
    ids = list(point_id)
    block_s = 3600.0 if block_if(large, turns, ["video_id"], time_block("start_s")) is not None else None
    found = as_of(points.select("video_id", *ids, point), turns, ["video_id"], point, "start_s", ["start_s", "end_s", "speaker"], ids, block_s)
    edge = lambda c: turns.select("video_id", F.col(c).alias("__e"), F.col("start_s").alias("__o"), F.col("end_s").alias("__o2"), F.col("speaker").alias("__who"))
    edges = edge("start_s").unionByName(edge("end_s"))
    near = asof_nearest(points.select("video_id", *ids, point), edges, ["video_id"], point, "__e", ["__o", "__o2", "__who"], ids, block_s=block_s)
    t = F.col(point)
    who = (
        F.when(F.col("last_turn").isNull() & F.col("next_turn").isNull(), F.lit(UNKNOWN))
        .when(F.col("last_turn").isNull(), F.col("next_turn.speaker"))
        .when(t < F.col("last_turn.end_s"), F.col("last_turn.speaker"))
        .otherwise(F.col("__who"))
    )
    near = near.select("video_id", *ids, "__who")
    named = found.join(near, ["video_id", *ids], "left").select("video_id", *ids, who.alias("speaker"))
    return points.drop("speaker").join(named, ["video_id", *ids])


def speaker_totals(turns: DataFrame) -> DataFrame:
    return turns.groupBy("video_id", "speaker").agg(F.sum(F.col("end_s") - F.col("start_s")).alias("seconds"))


# ---- slots ------------------------------------------------------------------------------------------------------


def slot_name(rank: Column, n: Column) -> Column:
    return (
        F.when(n <= 1, "single")
        .when(n == 2, F.element_at(F.array(F.lit("left"), F.lit("right")), rank + 1))
        .when(n == 3, F.element_at(F.array(F.lit("left"), F.lit("center"), F.lit("right")), rank + 1))
        .otherwise(F.element_at(F.array(F.lit("left"), F.lit("left_center"), F.lit("right_center"), F.lit("right")), rank + 1))
    )


def assign_slots(detections: DataFrame, frame: Sequence[str] = ("video_id", "t_s")) -> DataFrame:
    """Rank the faces of a frame from left to right; the first four are slots."""
    order = Window.partitionBy(*frame).orderBy("cx", *[c for c in ("face_id",) if c in detections.columns])
    return detections.withColumn("slot", F.row_number().over(order) - 1).where(F.col("slot") < MAX_SLOTS)


def mean_vector(df: DataFrame, keys: Sequence[str], vector: str, name: str, normalise: str = "unit") -> DataFrame:
    """Element-wise mean per key: one row per element is averaged with map-side combine, so a huge key is no problem."""
    parts = df.where(F.col(vector).isNotNull()).select(*keys, F.posexplode(vector).alias("__i", "__v"))
    means = parts.groupBy(*keys, "__i").agg(F.avg(F.col("__v").cast("double")).alias("__m"))
    arrays = means.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("__i", "__m"))).alias("__a"))
    vec = F.transform("__a", lambda x: x["__m"])
    if normalise == "unit":
        vec = unit(vec)
    elif normalise == "sum":
        total = F.aggregate(vec, F.lit(1e-9), lambda s, v: s + v)
        vec = F.transform(vec, lambda v: v / total)
    return arrays.select(*keys, vec.alias(name))


def aggregate_slots(slotted: DataFrame, keys: Sequence[str] = ("video_id", "template_id", "slot")) -> DataFrame:
    """Median box and centre, mean confidence, mean vectors and colour of the faces of a slot."""
    keys = list(keys)
    med = lambda c: F.percentile(c, F.lit(0.5)).alias(c)
    have = set(slotted.columns)
    colour = [F.rint(F.avg(c)).cast("int").alias(c) for c in ("shirt_r", "shirt_g", "shirt_b") if c in have]
    base = slotted.groupBy(*keys).agg(
        *[med(c) for c in ("x1", "y1", "x2", "y2", "cx", "cy")], F.avg("conf").alias("confidence"), F.count("*").alias("n_obs"), *colour
    )
    if "embedding" in have:
        base = base.join(mean_vector(slotted, keys, "embedding", "embedding"), keys, "left")
    if "shirt_hist" in have:
        base = base.join(mean_vector(slotted, keys, "shirt_hist", "shirt_hist", "sum"), keys, "left")
    return base


def crop_size(width: Column, height: Column) -> tuple[Column, Column]:
    """9:16 crop of full height."""
    return F.least(F.floor(height * 9 / 16), width.cast("bigint")).cast("double"), height.cast("double")


def crop_from_face(cx: Column, cy: Column, yaw: Column, width: Column, height: Column) -> Column:
    """STRUCT<x, y>: corner of the crop that frames a face, with room towards where it looks and above it."""
    w, h = crop_size(width, height)
    nose = clamp_col(-(F.coalesce(yaw, F.lit(0.0)) / 45.0) * (w * NOSE_ROOM), -w * MAX_NOSE, w * MAX_NOSE)
    return F.struct(
        clamp_col(cx - w / 2.0 + nose, F.lit(0.0), F.greatest(F.lit(0.0), width - w)).alias("x"),
        clamp_col(cy - h * HEAD_ROOM, F.lit(0.0), F.greatest(F.lit(0.0), height - h)).alias("y"),
    )


def clamp_col(c: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, c))


def template_geometry(slots: DataFrame, frames: DataFrame) -> DataFrame:
    """Layout of each template from its slots: type, crop anchor from the dominant slot, wide test.

    slots (video_id, template_id, slot, x1..y2, cx, cy, confidence); frames (video_id, width, height).
    """
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    stats = slots.groupBy("video_id", "template_id").agg(
        F.count("*").alias("n_faces"),
        F.max_by(F.struct("slot", "cx", "cy"), F.struct(F.col("confidence") * area, -F.col("slot"))).alias("dom"),
        F.min("cx").alias("__left"), F.max("cx").alias("__right"),
    ).join(frames.select("video_id", "width", "height"), "video_id")
    w, _ = crop_size(F.col("width"), F.col("height"))
    crop = crop_from_face(F.col("dom.cx"), F.col("dom.cy"), F.lit(0.0), F.col("width"), F.col("height"))
    kind = F.when(F.col("n_faces") <= 1, "SINGLE").when(F.col("n_faces") == 2, "WIDE").otherwise("MULTI")
    spread = (F.col("__right") - F.col("__left")) / F.greatest(F.lit(1), F.col("width"))
    wide = (kind == "WIDE") | ((F.col("n_faces") >= 2) & ((spread >= WIDE_SPREAD) | (w / F.col("width") <= WIDE_CROP_SHARE)))
    return stats.select(
        "video_id", "template_id", "n_faces", kind.alias("type"), F.col("dom.slot").alias("dominant_slot"),
        crop["x"].alias("crop_x"), crop["y"].alias("crop_y"), w.alias("crop_w"), F.col("height").cast("double").alias("crop_h"), wide.alias("is_wide"),
    )


# ---- labels -----------------------------------------------------------------------------------------------------


def speaker_prototypes(samples: DataFrame, keys: Sequence[str] = ("video_id", "speaker")) -> DataFrame:
    """Normalised mean embedding per speaker, UNKNOWN left out. samples (video_id, speaker, embedding)."""
    return mean_vector(samples.where(F.col("speaker") != UNKNOWN), list(keys), "embedding", "prototype")


def prototype_samples(scenes: DataFrame, slots: DataFrame, turns: DataFrame, large: bool | None = None) -> DataFrame:
    """The slot embedding that stands for the speaker of each scene.

    It is the only slot, or the dominant one when its confidence leads by 0.15. scenes (video_id, scene, template_id,
    type, start_s, end_s), slots (video_id, template_id, slot, x1..y2, confidence, embedding).
    """
    area = F.greatest(F.lit(1e-6), (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")))
    order = Window.partitionBy("video_id", "template_id").orderBy((F.col("confidence") * area).desc(), "slot")
    ranked = slots.withColumns({
        "__r": F.row_number().over(order), "__lead": F.col("confidence") - F.lead("confidence").over(order), "__n": F.count("*").over(Window.partitionBy("video_id", "template_id")),
    }).where("__r = 1")
    used = scenes.join(ranked, ["video_id", "template_id"]).where(
        ((F.col("__n") == 1) | (F.col("type") == "SINGLE") | (F.col("__lead") >= SLOT_GAP)) & F.col("embedding").isNotNull()
    )
    mid = used.select("video_id", "scene", "embedding", ((F.col("start_s") + F.col("end_s")) / 2.0).alias("t_s"))
    return active_speaker_at(mid, turns, "t_s", ("scene",), large).where(F.col("speaker") != UNKNOWN)


def manual_prototype_samples(slots: DataFrame, detections: DataFrame, frames_per_s: float = 25.0, per_speaker: int = 3) -> DataFrame:
    """Embeddings for labelled slots from frames around a template's own time.

    Eight offsets are tried in order; the first that gives any match serves the template. A face belongs to the slot
    whose box it overlaps best. At most three per speaker count, in template order. slots carry ``canonical_s``.
    """
    offsets = F.array(*[F.lit(x) for x in (0.0, 0.5, -0.5, 1.0, -1.0, 1.5, 2.0, -1.5)])
    tries = slots.where(F.coalesce("speaker", F.lit("")) != "").select(
        "video_id", "template_id", "slot", "speaker", *[F.col(c).alias(f"s_{c}") for c in ("x1", "y1", "x2", "y2")],
        F.posexplode(F.transform(offsets, lambda o: F.greatest(F.lit(0.0), F.col("canonical_s") + o))).alias("try", "__t"),
    ).withColumn("frame", F.rint(F.col("__t") * frames_per_s).cast("bigint"))
    faces = detections.withColumn("frame", F.rint(F.col("t_s") * frames_per_s).cast("bigint")).select("video_id", "frame", "face_id", "x1", "y1", "x2", "y2", "embedding")
    score = iou(*[F.col(c) for c in ("x1", "y1", "x2", "y2", "s_x1", "s_y1", "s_x2", "s_y2")])
    best = tries.join(faces, ["video_id", "frame"]).withColumn("__iou", score).where("__iou > 0").groupBy(
        "video_id", "template_id", "slot", "speaker", "try"
    ).agg(F.max_by("embedding", F.struct("__iou", -F.col("face_id"))).alias("embedding")).where("embedding is not null")
    first = best.groupBy("video_id", "template_id").agg(F.min("try").alias("try"))
    used = best.join(first, ["video_id", "template_id", "try"])
    order = Window.partitionBy("video_id", "speaker").orderBy("template_id", "slot")
    return used.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= per_speaker).select(
        "video_id", "template_id", "slot", "speaker", unit(F.col("embedding")).alias("embedding")
    )


def label_slots(slots: DataFrame, prototypes: DataFrame, threshold: float = EMBED_SIM, keys: Sequence[str] = ("video_id", "template_id", "slot"), on: Sequence[str] = ("video_id",)) -> DataFrame:
    """Nearest prototype by cosine when close enough; manual labels (``manual`` true with a speaker) stay.

    Prototypes are one row per speaker of a video, so the join multiplies slots by a handful.
    """
    proto = prototypes.select(*on, F.col("speaker").alias("__who"), "prototype")
    slim = slots.where(F.col("embedding").isNotNull()).select(*dict.fromkeys([*on, *keys]), "embedding")
    pairs = slim.join(proto, list(on))
    scored = pairs.select(*keys, "__who", cosine(F.col("embedding"), F.col("prototype")).alias("__sim"))
    # of equal similarities the speaker that sorts first
    best = scored.groupBy(*keys).agg(F.max("__sim").alias("similarity"), F.min(F.struct((-F.col("__sim")).alias("o"), F.col("__who").alias("who")))["who"].alias("__best"))
    out = slots.join(best, list(keys), "left")
    hit = F.when(F.col("similarity") >= threshold, F.col("__best"))
    have = "speaker" in slots.columns
    manual = (F.col("manual") & (F.coalesce("speaker", F.lit("")) != "")) if "manual" in slots.columns and have else F.lit(False)
    label = F.when(manual, F.col("speaker")).otherwise(F.coalesce(hit, F.col("speaker"))) if have else hit
    return out.withColumn("speaker", label).drop("__best")


def template_votes(items: DataFrame, turns: DataFrame, keep_unknown: bool = False, large: bool | None = None) -> DataFrame:
    """How often each speaker talks at the middle of the scenes or segments of a template, as a map.

    items (video_id, item_id, template_id, start_s, end_s).
    """
    mid = items.select("video_id", "item_id", "template_id", ((F.col("start_s") + F.col("end_s")) / 2.0).alias("t_s"))
    named = active_speaker_at(mid, turns, "t_s", ("item_id",), large)
    if not keep_unknown:
        named = named.where(F.col("speaker") != UNKNOWN)
    counts = named.groupBy("video_id", "template_id", "speaker").agg(F.count("*").alias("votes"))
    return counts.groupBy("video_id", "template_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("speaker", F.col("votes").cast("int"))))).alias("speaker_votes")
    )


def map_speakers(
    classified: DataFrame, turns: DataFrame, visual: DataFrame | None = None, large: bool | None = None
) -> DataFrame:
    """One-to-one map of spoken labels to visual labels, heaviest pairs first.

    classified (video_id, seg_index, start_s, end_s, confidence, visual_speaker, is_wide). With two of each and one
    pair found, the other pair follows. visual (video_id, speaker) lists every visual label.
    """
    solo = classified.where(~F.coalesce("is_wide", F.lit(False)) & (F.coalesce("visual_speaker", F.lit("")) != ""))
    mid = solo.withColumn("t_s", (F.col("start_s") + F.col("end_s")) / 2.0)
    named = active_speaker_at(mid, turns, "t_s", ("seg_index",), large).where(F.col("speaker") != UNKNOWN)
    weight = F.greatest(F.lit(0.05), F.col("end_s") - F.col("start_s")) * F.greatest(F.lit(0.25), F.col("confidence"))
    pairs = named.groupBy("video_id", "speaker", "visual_speaker").agg(F.sum(weight).alias("weight")).withColumn("__w", -F.col("weight"))
    # equal weights: the larger labels first
    order = Window.partitionBy("video_id").orderBy("__w", F.col("speaker").desc(), F.col("visual_speaker").desc())
    # a few rows a video, read by every step of the selection
    pairs = cut_lineage(pairs.withColumn("__r", F.row_number().over(order)))
    kept = greedy_select(
        pairs, ["video_id"], ["__r"], ["__r"], ["speaker", "visual_speaker"],
        lambda k, x: (k["speaker"] == x["speaker"]) | (k["visual_speaker"] == x["visual_speaker"]),
        F.array(F.xxhash64(F.lit("s"), "speaker"), F.xxhash64(F.lit("v"), "visual_speaker")),
    ).select("video_id", "speaker", "visual_speaker")
    names = turns.where((F.coalesce("speaker", F.lit("")) != "") & (F.col("speaker") != UNKNOWN)).groupBy("video_id").agg(F.collect_set("speaker").alias("__d"))
    seen = (visual if visual is not None else classified.select("video_id", F.col("visual_speaker").alias("speaker"))).where(F.coalesce("speaker", F.lit("")) != "")
    looks = seen.groupBy("video_id").agg(F.collect_set("speaker").alias("__v"))
    got = kept.groupBy("video_id").agg(F.collect_list("speaker").alias("__gd"), F.collect_list("visual_speaker").alias("__gv"))
    two = got.join(names, "video_id").join(looks, "video_id").where(
        (F.size("__d") == 2) & (F.size("__v") == 2) & (F.size("__gd") == 1)
    )
    rest = two.select("video_id", F.array_except("__d", "__gd").alias("__a"), F.array_except("__v", "__gv").alias("__b")).where(
        (F.size("__a") == 1) & (F.size("__b") == 1)
    ).select("video_id", F.col("__a")[0].alias("speaker"), F.col("__b")[0].alias("visual_speaker"))
    return kept.withColumn("inferred", F.lit(False)).unionByName(rest.withColumn("inferred", F.lit(True)))


def relabel_timeline(turns: DataFrame, mapping: DataFrame) -> DataFrame:
    m = mapping.select("video_id", "speaker", F.col("visual_speaker").alias("__to"))
    return turns.join(m, ["video_id", "speaker"], "left").withColumn("speaker", F.coalesce("__to", "speaker")).drop("__to")
