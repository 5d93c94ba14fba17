"""Job tables: latest stage records, what is stale, what is missing, how far a job is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Stages and their weights, and the settings that never enter a fingerprint.
STAGE_WEIGHTS = {
    "downloading": 6, "transcribing": 10, "analyzing": 12, "selecting": 4, "extracting": 34,
    "captioning": 22, "copywriting": 4, "blogging": 2, "packaging": 6,
}



def settings_fingerprint(settings: Column) -> Column:
    """Short hash of a MAP of settings without the secret ones, independent of their order."""
    open_ = F.map_filter(settings, lambda k, v: ~(F.lower(k).contains("key") | F.lower(k).contains("token") | F.lower(k).contains("secret")))
    return F.substring(F.sha1(F.to_json(F.sort_array(F.map_entries(open_)))), 1, 16)


def latest_stage(stage_runs: DataFrame, tie: str | None = None) -> DataFrame:
    """Last record per job and stage: a map-side combined maximum, no window."""
    rest = [c for c in stage_runs.columns if c not in ("job_id", "stage")]
    order = F.struct("updated_at", *([tie] if tie else []))
    return stage_runs.groupBy("job_id", "stage").agg(F.max_by(F.struct(*rest), order).alias("__r")).select("job_id", "stage", "__r.*")


def stale_stages(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Stages to run again and why. Both (job_id, stage, settings_fp, inputs MAP); previous holds the latest records."""
    flat = lambda m: F.to_json(F.sort_array(F.map_entries(m)))
    old = previous.select("job_id", "stage", F.col("settings_fp").alias("__fp"), flat(F.col("inputs")).alias("__in"), F.lit(True).alias("__seen"))
    joined = current.join(old, ["job_id", "stage"], "left")
    reason = (
        F.when(F.col("__seen").isNull(), "no previous stage state")
        .when(~flat(F.col("inputs")).eqNullSafe(F.col("__in")), "input artifacts changed")
        .when(~F.col("settings_fp").eqNullSafe(F.col("__fp")), "settings fingerprint changed")
    )
    return joined.select("job_id", "stage", reason.isNotNull().alias("stale"), F.coalesce(reason, F.lit("unchanged")).alias("reason"))


def missing_artifacts(expected: DataFrame, files: DataFrame) -> DataFrame:
    """Expected artifacts (job_id, path, is_json) that are missing, empty or not readable JSON. files (job_id, path, size, content)."""
    have = files.select("job_id", "path", "size", "content", F.lit(True).alias("__seen"))
    joined = expected.join(have, ["job_id", "path"], "left")
    bad_json = F.col("is_json") & F.try_parse_json(F.col("content")).isNull()
    problem = F.when(F.col("__seen").isNull(), "missing").when(F.coalesce("size", F.lit(0)) <= 0, "empty").when(bad_json, "invalid_json")
    return joined.withColumn("problem", problem).where("problem is not null").select("job_id", "path", "problem")


def missing_clips(plans: DataFrame, files: DataFrame) -> DataFrame:
    """Planned clips without a raw file."""
    return plans.where(F.coalesce("clip_name", F.lit("")) != "").join(
        files.where(F.col("kind") == "raw").select("video_id", "clip_name"), ["video_id", "clip_name"], "left_anti"
    ).select("video_id", "clip_name")


def pipeline_progress(stage_runs: DataFrame, weights: dict[str, int] | None = None, done: tuple[str, ...] = ("done",)) -> DataFrame:
    """Percent per job: weights of the finished stages, plus the running stage's own share when it reports ``percent``.

    The weights are a constant of a few entries and travel with the expression.
    """
    table = STAGE_WEIGHTS if weights is None else weights
    weight = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col("stage")), F.lit(0))
    finished = F.col("status").isin(*done)
    own = F.coalesce(F.col("percent").cast("double") / 100.0, F.lit(0.0)) if "percent" in stage_runs.columns else F.lit(0.0)
    share = F.when(finished, F.lit(1.0)).otherwise(own)
    return stage_runs.groupBy("job_id").agg(
        F.floor(F.sum(weight * share) / float(sum(table.values())) * 100.0 + 1e-9).cast("int").alias("percent"), F.count_if(finished).alias("stages_done")
    )


def log_tail(lines: DataFrame, n: int = 50) -> DataFrame:
    """Last ``n`` lines per job; a filter on the row number keeps n rows per partition before the shuffle."""
    order = Window.partitionBy("job_id").orderBy(F.col("line_no").desc())
    return lines.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= n).drop("__r")


def job_status(stage: Column) -> Column:
    return (
        F.when(stage == "done", "done").when(stage == "error", "error").when(stage == "review", "paused_for_review")
        .when(stage == "paused_external_llm", "paused_for_external_llm").otherwise("processing")
    )


def latest_status(events: DataFrame, tie: str | None = None) -> DataFrame:
    """Latest stage, status, progress and message per job (batch form of the stream)."""
    order = F.struct("ts", *([tie] if tie else []))
    return events.groupBy("job_id").agg(F.max_by(F.struct("stage", "progress", "message"), order).alias("__e"), F.max("ts").alias("updated_at")).select(
        "job_id", "__e.stage", job_status(F.col("__e.stage")).alias("status"), "__e.progress", "__e.message", "updated_at"
    )


def request_rate(calls: DataFrame, seconds: int = 60, limit: int | None = None) -> DataFrame:
    """Calls of the same key in the last ``seconds`` up to each call, and whether that passes ``limit``.

    calls (key, call_id, ts). The half-open window (t - seconds, t] never reaches past the block before the call's
    own when blocks are at least ``seconds`` long, so blocks are independent once each call also stands in the block in which it
    leaves the window. There it is one step up at its time and one down when it leaves; the running sum of the steps is the
    count, so a call is not counted again for every later call of its window.
    """
    width = max(seconds, 60)
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))
    at, left = F.col("__us"), F.col("__us") + seconds * 1_000_000
    block = lambda us: F.floor(us / (width * 1_000_000))
    step = lambda b, us, by, own: F.struct(b.alias("__b"), us.alias("__at"), F.lit(by).alias("__step"), F.lit(own).alias("__own"))
    here, after = block(at), block(at) + 1
    steps = F.array(step(here, at, 1, True), step(here, left, -1, False), step(after, at, 1, False), step(after, left, -1, False))
    both = calls.withColumn("__us", micros).select("*", F.inline(F.filter(steps, lambda x: x["__own"] | (x["__b"] == block(left)))))
    upto = Window.partitionBy("key", "__b").orderBy("__at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    out = both.withColumn("calls_in_window", F.sum("__step").over(upto)).where("__own").drop("__b", "__own", "__us", "__at", "__step")
    return out.withColumn("over_limit", F.col("calls_in_window") > limit) if limit is not None else out
