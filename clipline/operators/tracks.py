"""Crop tracks: which face leads, a smoothed path, and a regular resampling of it.

State runs along one segment (a shot); it is read in blocks of time, so a segment may be of any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import bhattacharyya, cosine, round_to
from .ordered import block_if, lag, last_seen, next_seen, time_block, with_ordered
from .scan import decaying_means
from .speakers import clamp_col, crop_from_face, crop_size

# Dwell, smoothing and matching limits.
DWELL_S = 1.0
ALPHA = 0.35
STABLE_START_S = 0.10
SLOT_MATCH_MAX = 1.25
MIN_CONFIDENCE = 0.15
KEY = ["video_id", "seg_index"]


def dwell_gate(ticks: DataFrame, dwell_s: float = DWELL_S, large: bool | None = None) -> DataFrame:
    """Committed speaker per tick: a change counts once the new speaker has held for ``dwell_s``.

    ticks (video_id, seg_index, t_s, speaker); UNKNOWN and NULL count as the committed one, but end a run. The first tick commits.
    A run of one speaker commits at its first tick that is ``dwell_s`` after its start, whoever was committed before, so the speaker of
    the last such tick holds.
    """
    block = block_if(large, ticks, KEY, time_block("t_s", 600.0))
    order = ["t_s", "speaker"]
    named = ticks.select(*KEY, "t_s", F.coalesce("speaker", F.lit("UNKNOWN")).alias("speaker"))
    near = with_ordered(named, KEY, order, {"__before": lag(F.col("speaker"))}, block)
    first = F.col("__before").isNull()
    runs = with_ordered(near, KEY, order, {"__since": last_seen(F.when(first | (F.col("__before") != F.col("speaker")), F.col("t_s")))}, block)
    sure = first | ((F.col("speaker") != "UNKNOWN") & (F.col("t_s") - F.col("__since") >= dwell_s))
    return with_ordered(runs, KEY, order, {"committed": last_seen(F.when(sure, F.col("speaker")))}, block).select(*KEY, "t_s", "committed")


def _similar(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), cosine(a, b))


def choose_slot(slots: DataFrame, ticks: DataFrame) -> DataFrame:
    """Slot for the committed speaker of each tick: confidence, label, width and likeness to the speaker's prototype.

    slots (video_id, template_id, slot, confidence, speaker, x1, x2, embedding), ticks (video_id, seg_index, t_s,
    template_id, committed, proto, is_wide).
    """
    joined = ticks.join(slots.withColumnRenamed("speaker", "__label"), ["video_id", "template_id"])
    same = F.coalesce(F.col("__label") == F.col("committed"), F.lit(False))
    score = (
        F.col("confidence")
        + F.when(same, 2.0).when(F.coalesce("__label", F.lit("")) != "", -0.2).otherwise(0.0)
        + F.when(F.col("is_wide"), 0.01 * F.abs(F.col("x2") - F.col("x1"))).otherwise(0.0)
        + 0.90 * F.coalesce(_similar(F.col("embedding"), F.col("proto")), F.lit(0.0))
    )
    return joined.groupBy(*KEY, "t_s").agg(F.max_by("slot", F.struct(score, -F.col("slot"))).alias("slot"))


def focus_faces(faces: DataFrame, ticks: DataFrame, slots: DataFrame, min_conf: float = 0.3) -> DataFrame:
    """Leading face per tick.

    Wide shots: without embeddings the face nearest the slot of the committed speaker (no farther than 1.25 slot
    diagonals), else the face most like the speaker and the template. Solo shots: the most central and largest.
    faces (video_id, seg_index, t_s, face_id, x1..y2, cx, cy, area, yaw, conf, embedding, shirt_hist);
    ticks (video_id, seg_index, t_s, template_id, committed, proto, is_wide, width, height).
    """
    tick = [*KEY, "t_s"]
    joined = faces.join(ticks, tick)
    whole = Window.partitionBy(*tick)
    joined = joined.withColumns({
        "__emb": F.max(F.col("embedding").isNotNull()).over(whole), "__maxarea": F.max("area").over(whole), "__count": F.count("*").over(whole),
    })
    slot_items = slots.groupBy("video_id", "template_id").agg(F.sort_array(F.collect_list(F.struct("slot", "speaker", "cx", "cy", "x1", "y1", "x2", "y2", "embedding", "shirt_hist"))).alias("__slots"))
    joined = joined.join(slot_items, ["video_id", "template_id"], "left")
    mine = F.get(F.filter("__slots", lambda s: s["speaker"] == F.col("committed")), F.lit(0))
    diag = F.hypot(F.greatest(F.lit(1.0), mine["x2"] - mine["x1"]), F.greatest(F.lit(1.0), mine["y2"] - mine["y1"]))
    off = F.hypot(F.col("cx") - mine["cx"], F.col("cy") - mine["cy"]) / F.greatest(F.lit(1.0), diag)
    by_place = -off * 2.0 + 0.5 * F.col("conf") + 0.0001 * F.col("area")
    best = lambda f: F.array_max(F.transform("__slots", f))
    zero = F.lit(0.0)
    by_look = (
        F.col("conf") * 0.65 + F.least(F.lit(1.0), F.col("area") / F.greatest(F.lit(1.0), F.col("area") + 1.0)) * 0.35
        + F.coalesce(_similar(F.col("embedding"), F.col("proto")), zero)
        + 0.25 * F.coalesce(best(lambda s: _similar(F.col("embedding"), s["embedding"])), zero)
        + 0.15 * F.coalesce(best(lambda s: F.when(F.col("shirt_hist").isNotNull() & s["shirt_hist"].isNotNull(), 1.0 - bhattacharyya(F.col("shirt_hist"), s["shirt_hist"]))), zero)
        + F.greatest(zero, F.coalesce(best(lambda s: F.when(s["speaker"] == F.col("committed"), 0.65 * _similar(F.col("embedding"), s["embedding"]))), zero))
    )
    size = F.hypot(F.col("width"), F.col("height"))
    centre = F.hypot(F.col("cx") - F.col("width") / 2.0, F.col("cy") - F.col("height") / 2.0) / F.greatest(F.lit(1.0), size)
    solo = -centre * 1.5 + F.col("area") / F.greatest(F.lit(1e-9), F.col("__maxarea")) + 0.25 * F.col("conf")
    placed = F.col("is_wide") & ~F.col("__emb") & mine.isNotNull()
    score = F.when(placed, by_place).when(F.col("is_wide"), by_look).when(F.col("conf") >= min_conf, solo)
    scored = joined.withColumns({"__score": score, "__off": F.when(placed, off)})
    face = F.struct("face_id", "cx", "cy", "yaw", "conf", F.col("__off").alias("off"))
    picked = scored.where("__score is not null").groupBy(*tick).agg(F.max_by(face, F.struct("__score", -F.col("face_id"))).alias("__f"))
    return picked.where(F.col("__f.off").isNull() | (F.col("__f.off") <= SLOT_MATCH_MAX)).select(*tick, "__f.face_id", "__f.cx", "__f.cy", "__f.yaw", "__f.conf")


def focus_track(faces: DataFrame, ticks: DataFrame, slots: DataFrame, dwell_s: float = DWELL_S, fallback_conf: float = 0.35) -> DataFrame:
    """Wanted crop corner per tick, NULL where a solo subject is lost.

    A wide shot stays on the slot of the committed speaker and leans 5 % to a confident face; a solo shot follows the
    face. ticks (video_id, seg_index, t_s, template_id, speaker, proto, is_wide, width, height).
    """
    tick = [*KEY, "t_s"]
    gated = ticks.join(dwell_gate(ticks, dwell_s), tick)
    lead = focus_faces(faces, gated, slots)
    chosen = choose_slot(slots, gated.where("is_wide")).join(
        gated.select(*tick, "template_id"), tick
    ).join(slots.select("video_id", "template_id", "slot", F.col("cx").alias("__sx"), F.col("cy").alias("__sy")), ["video_id", "template_id", "slot"]).drop("template_id")
    joined = gated.join(lead, tick, "left").join(chosen, tick, "left")
    size = (F.col("width").cast("double"), F.col("height").cast("double"))
    by_face = crop_from_face(F.col("cx"), F.col("cy"), F.col("yaw"), *size)
    by_slot = crop_from_face(F.col("__sx"), F.col("__sy"), F.lit(0.0), *size)
    leans = F.col("conf") >= fallback_conf
    wide = lambda c: F.when(leans, 0.95 * by_slot[c] + 0.05 * by_face[c]).otherwise(by_slot[c])
    want = lambda c: F.when(F.col("is_wide"), wide(c)).otherwise(F.when(F.col("cx").isNotNull(), by_face[c]))
    conf = F.when(F.col("cx").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("conf")))).when(F.col("is_wide"), F.lit(0.15)).otherwise(F.lit(0.0))
    return joined.select(*tick, "committed", "slot", want("x").alias("x"), want("y").alias("y"), conf.alias("confidence"), "width", "height")


def smooth_track(targets: DataFrame, alpha: float = ALPHA, stable_s: float = STABLE_START_S, base: tuple[float, float] = (0.0, 0.0), large: bool | None = None) -> DataFrame:
    """Smoothed crop path per segment.

    targets (video_id, seg_index, t_rel, x, y, confidence), x or y NULL on a miss, optional width and height to clamp to.
    The first target locks and fills what came before; later ones move by ``alpha``; misses hold and take the position
    at which the subject is found again. The start is then set to the first confident position at or after ``stable_s``.
    """
    have = "width" in targets.columns
    if have:
        w, h = crop_size(F.col("width"), F.col("height"))
        room = (F.greatest(F.lit(0.0), F.col("width") - w), F.greatest(F.lit(0.0), F.col("height") - h))
        targets = targets.withColumns({c: F.when(F.col(c).isNotNull(), clamp_col(F.col(c), F.lit(0.0), r)) for c, r in zip("xy", room)})
    block = block_if(large, targets, KEY, time_block("t_rel", 600.0))
    row = [*KEY, "t_rel", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "confidence")]]
    found = targets.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select(*row)
    eased = decaying_means(found, KEY, ["t_rel", "x", "y", "confidence"], ["x", "y"], alpha, block)
    none = F.lit(None).cast("double")
    missed = targets.where(F.col("x").isNull() | F.col("y").isNull()).select(*KEY, "t_rel", none.alias("x"), none.alias("y"), F.lit(0.0).alias("confidence"))
    path = eased.unionByName(missed)
    spot = F.when(F.col("x").isNotNull(), F.struct("x", "y"))
    held = with_ordered(path, KEY, ["t_rel", "confidence", "x", "y"], {"__next": next_seen(spot), "__last": last_seen(spot)}, block)
    at = lambda c, b: F.coalesce(F.col(f"__next.{c}"), F.col(f"__last.{c}"), F.lit(b))
    filled = held.select(*KEY, "t_rel", at("x", base[0]).alias("crop_x"), at("y", base[1]).alias("crop_y"), "confidence")
    return _stable_start(filled, stable_s)


def _stable_start(track: DataFrame, offset_s: float) -> DataFrame:
    sure = F.col("confidence") > MIN_CONFIDENCE
    late = sure & (F.col("t_rel") >= offset_s - 1e-4)
    spot = F.struct("t_rel", "crop_x", "crop_y", "confidence")
    anchor = track.groupBy(*KEY).agg(
        F.min(F.when(late, spot)).alias("__late"), F.min(F.when(sure, spot)).alias("__any"), F.max(F.abs("t_rel") <= 1e-4).alias("__has0")
    ).select(*KEY, F.coalesce("__late", "__any").alias("__a"), "__has0")
    joined = track.join(anchor, KEY)
    early = F.col("__a").isNotNull() & (F.col("t_rel") <= F.greatest(F.lit(0.0), F.col("__a.t_rel")) + 1e-4)
    moved = joined.select(
        *KEY, F.when(F.abs("t_rel") <= 1e-4, 0.0).otherwise(F.col("t_rel")).alias("t_rel"),
        F.when(early, F.col("__a.crop_x")).otherwise(F.col("crop_x")).alias("crop_x"), F.when(early, F.col("__a.crop_y")).otherwise(F.col("crop_y")).alias("crop_y"), "confidence",
    )
    start = anchor.where("__a is not null and not __has0").select(*KEY, F.lit(0.0).alias("t_rel"), "__a.crop_x", "__a.crop_y", "__a.confidence")
    return moved.unionByName(start)


def resample_track(keyframes: DataFrame, fps: float = 25.0, half: int = 3) -> DataFrame:
    """Confident keyframes interpolated on a regular grid and averaged over seven rows.

    keyframes (video_id, seg_index, t_rel, crop_x, crop_y, confidence). Segments with fewer than two give nothing.
    """
    eps = 1e-6
    step = 1.0 / max(1.0, fps)
    valid = keyframes.where(F.col("confidence") > MIN_CONFIDENCE).select(*KEY, "t_rel", "crop_x", "crop_y")
    span = valid.groupBy(*KEY).agg(F.max("t_rel").alias("__end"), F.count("*").alias("__n")).where("__n >= 2")
    n = F.greatest(F.lit(0), F.ceil((F.col("__end") - eps) / step) - 1).cast("int")
    times = F.array_distinct(F.concat(F.transform(F.sequence(F.lit(0), n), lambda k: round_to(k * step, 4)), F.array(round_to(F.col("__end"), 4))))
    grid = span.select(*KEY, F.explode(times).alias("t"))
    both = grid.select(*KEY, F.col("t").alias("__k"), F.lit(0).alias("__kind"), "t").unionByName(
        valid.join(span.select(*KEY), KEY, "left_semi").select(*KEY, (F.col("t_rel") + eps).alias("__k"), F.lit(1).alias("__kind"), F.struct("t_rel", "crop_x", "crop_y").alias("__kf")),
        allowMissingColumns=True,
    )
    # a keyframe at the very time of a grid row comes after it: it is the right end of the stretch
    near = with_ordered(both, KEY, ["__k", "__kind", "__kf"], {"__p": last_seen(F.col("__kf")), "__q": next_seen(F.col("__kf"))}).where("__kind = 0")
    t0, t1 = F.col("__p.t_rel"), F.col("__q.t_rel")
    u = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("t") - t0) / (t1 - t0)))

    def at(c):
        p, q = F.col(f"__p.{c}"), F.col(f"__q.{c}")
        return F.when(F.col("__p").isNull(), q).when(F.col("__q").isNull(), p).when(t1 <= t0 + eps, q).otherwise(p + (q - p) * u)

    smooth = Window.partitionBy(*KEY).orderBy("t").rowsBetween(-half, half)
    lined = near.select(*KEY, F.col("t").alias("t"), at("crop_x").alias("__x"), at("crop_y").alias("__y"))
    return lined.select(*KEY, F.col("t").alias("t_rel"), F.avg("__x").over(smooth).alias("crop_x"), F.avg("__y").over(smooth).alias("crop_y"))
