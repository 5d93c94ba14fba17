"""Streams of job events, calls and growing transcripts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.jobs import job_status
from ..operators.windows import OVERLAP_S, WINDOW_S
from .sinks import latest, upsert_stream

JOB_EVENT = "job_id long, stage string, progress int, message string, ts timestamp, event_id long"


def newest_events(events: DataFrame) -> DataFrame:
    """The newest event of each job, one row per job: by time, then by ``event_id``. Combines on the map side, for a batch as for a table."""
    fields = ["ts", "event_id", "stage", "progress", "message"]
    return events.groupBy("job_id").agg(F.max_by(F.struct(*fields), F.struct("ts", "event_id")).alias("__e")).select("job_id", *[f"__e.{c}" for c in fields])


def job_status_stream(events: DataFrame, folder: str, **trigger) -> StreamingQuery:
    """Keep the table of the newest event per job in ``folder``. events (job_id, stage, progress, message, ts, event_id).

    Which event is the newest is settled by its own time, when the table is read, so the stream has no state: nothing of a finished
    job is kept, and an event may be as late as it likes.
    """
    return upsert_stream(events.select("job_id", "stage", "progress", "message", "ts", "event_id"), folder, newest_events, "append", **trigger)


def job_status_table(spark: SparkSession, folder: str) -> DataFrame:
    """Latest stage, status, progress and message per job, from the table that ``job_status_stream`` keeps."""
    newest = latest(spark, folder, ["job_id"], ["ts", "event_id"])
    return newest.select("job_id", "stage", job_status(F.col("stage")).alias("status"), "progress", "message", F.col("ts").alias("updated_at"))


class Heartbeat(StatefulProcessor):
    """Last event per job, and a beat every few seconds until the job is done or failed. What is silent too long is forgotten."""

    def __init__(self, every_s: float = 10.0, forget_s: float = 86400.0):
        self.every_ms, self.forget_ms = int(every_s * 1000), int(forget_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "stage string, progress int, message string, ts_us long, event_id long, timer_ms long", self.forget_ms)

    def _row(self, key, last, now_ms: int, beat: bool) -> pd.DataFrame:
        stage, progress, message, at_us, event, _ = last
        status = {"done": "done", "error": "error", "review": "paused_for_review", "paused_external_llm": "paused_for_external_llm"}.get(stage, "processing")
        return pd.DataFrame({
            "job_id": [key[0]], "stage": [stage], "status": [status], "progress": [progress], "message": [message], "heartbeat": [beat],
            "stale_seconds": [max(0, now_ms - at_us // 1000) // 1000], "event_id": [event],
        })

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = int(timerValues.getCurrentProcessingTimeInMs())
        last = tuple(self.last.get()) if self.last.exists() else None
        for batch in rows:
            for stage, progress, message, at_us, event in zip(batch["stage"], batch["progress"], batch["message"], batch["ts_us"], batch["event_id"], strict=True):
                if last is None or (at_us, event) >= last[3:5]:
                    last = (stage, int(progress), message, int(at_us), int(event), last[5] if last else 0)
        if last[0] in ("done", "error"):
            if last[5]:
                self.handle.deleteTimer(last[5])
            self.last.clear()
        else:
            timer = last[5]
            if not timer:
                timer = now + self.every_ms
                self.handle.registerTimer(timer)
            last = (*last[:5], timer)
            self.last.update(last)
        yield self._row(key, last, now, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.last.exists():
            return
        now = int(timerValues.getCurrentProcessingTimeInMs())
        last = (*tuple(self.last.get())[:5], now + self.every_ms)
        self.handle.registerTimer(last[5])
        self.last.update(last)
        yield self._row(key, last, now, True)

    def close(self) -> None:
        pass


def stale_jobs_stream(events: DataFrame, every_s: float = 10.0, forget_s: float = 86400.0) -> DataFrame:
    """Each update of a job and a beat with the seconds since the last one; silent after done or error.

    events (job_id, stage, progress, message, ts, event_id). Needs the RocksDB state store. Run in update mode. The state of a job goes
    when it ends or after ``forget_s`` without an event or beat.
    """
    key = dict(events.dtypes)["job_id"]
    slim = events.select("job_id", "stage", F.coalesce("progress", F.lit(0)).alias("progress"), "message", F.unix_micros("ts").alias("ts_us"), "event_id")
    return slim.where("ts_us is not null").groupBy("job_id").transformWithStateInPandas(
        Heartbeat(every_s, forget_s),
        f"job_id {key}, stage string, status string, progress int, message string, heartbeat boolean, stale_seconds long, event_id long",
        "Update",
        "ProcessingTime",
    )


def request_rate_stream(calls: DataFrame, seconds: int = 60, slide: int = 1, limit: int | None = None, lateness: str = "2 minutes") -> DataFrame:
    """Calls per key in sliding windows (key, ts); append mode gives each window once it is closed."""
    counts = calls.withWatermark("ts", lateness).groupBy("key", F.window("ts", f"{seconds} seconds", f"{slide} seconds").alias("w")).agg(F.count("*").alias("calls"))
    out = counts.select("key", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "calls")
    return out.withColumn("over_limit", F.col("calls") > limit) if limit is not None else out


def live_windows(segments: DataFrame, width_s: float = WINDOW_S, overlap_s: float = OVERLAP_S, lateness: str = "10 minutes") -> DataFrame:
    """Sliding transcript windows while segments arrive (video_id, seg_id, begin, finish timestamps, text).

    A segment names every window of the grid it overlaps (a plain sliding window on its start would miss those that
    only its tail reaches). Windows count from the epoch of the stream's clock; repeated segments count once. The end
    of a window is its event time: append mode gives a window once segments ``lateness`` later have come, and its
    state goes then. ``lateness`` should be no shorter than a window.
    """
    step = float(width_s - overlap_s)
    start = F.unix_micros("begin") / 1e6
    end = F.unix_micros("finish") / 1e6
    low = F.greatest(F.lit(0), F.floor((start - width_s) / step))
    ids = F.filter(F.sequence(low, F.floor(end / step)), lambda k: (end > k * step) & (start < k * step + width_s))
    spread = segments.select("video_id", "seg_id", F.length("text").alias("__n"), F.explode(ids).alias("k"))
    clock = spread.withColumn("at", F.timestamp_micros(((F.col("k") * step + width_s) * 1e6).cast("bigint"))).withWatermark("at", lateness)
    once = clock.dropDuplicates(["video_id", "seg_id", "at"])
    counted = once.groupBy("video_id", "at").agg(F.count("*").alias("n_segments"), F.sum("__n").alias("n_chars"), F.min("seg_id").alias("first_seg"), F.max("seg_id").alias("last_seg"))
    return counted.withColumn("window_start", F.timestamp_micros(F.unix_micros("at") - int(width_s * 1e6))).drop("at")
