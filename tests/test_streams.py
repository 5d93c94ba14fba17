"""Streams over files, compared with their batch form."""

import datetime as dt
import tempfile
import uuid

import pytest

from clipline.operators.jobs import latest_status
from clipline.streaming import jobs as s
from clipline.streaming import sinks


def start(spark, rows, schema):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).parquet(folder), folder


def run(spark, df, mode, seconds=None):
    """All there is, or what a few seconds give where timers keep the stream alive."""
    name = f"t_{uuid.uuid4().hex[:8]}"
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    q = (q.trigger(availableNow=True) if seconds is None else q.trigger(processingTime="1 second")).start()
    q.awaitTermination() if seconds is None else q.awaitTermination(seconds)
    q.stop()
    return spark.table(name)


T0 = dt.datetime(2024, 1, 1)
ROWS = [(1, "downloading", 5, "a", T0, 1), (1, "analyzing", 30, "b", T0 + dt.timedelta(seconds=50), 2), (2, "error", 10, "bad", T0 + dt.timedelta(seconds=5), 3), (3, "review", 60, "r", T0, 4), (1, "transcribing", 20, "late", T0 + dt.timedelta(seconds=20), 5)]
MORE = [(1, "done", 100, "end", T0 + dt.timedelta(seconds=90), 6), (3, "late", 1, "older", T0 - dt.timedelta(days=400), 7), (4, "downloading", 1, "new", T0, 8), (4, "analyzing", 2, "same time", T0, 9)]


def add(spark, folder, rows, schema=s.JOB_EVENT):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, old)


def test_job_status_equals_batch_and_goes_on_after_a_restart(spark):
    stream, source = start(spark, ROWS, s.JOB_EVENT)
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for more in ([], MORE, []):
        if more:
            add(spark, source, more)
        s.job_status_stream(stream, folder).awaitTermination()
        got = sorted(tuple(r) for r in s.job_status_table(spark, folder).collect())
        assert got == sorted(tuple(r) for r in latest_status(spark.read.parquet(source), "event_id").collect())
    assert {r[0]: r[2] for r in got} == {1: "done", 2: "error", 3: "paused_for_review", 4: "processing"}
    sinks.compact(spark, folder, f"{folder}-small", ["job_id"], ["ts", "event_id"])
    assert sorted(tuple(r) for r in s.job_status_table(spark, f"{folder}-small").collect()) == got


def test_a_batch_written_twice_counts_once(spark):
    stream, _ = start(spark, ROWS, s.JOB_EVENT)
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    s.job_status_stream(stream, folder).awaitTermination()
    rows = spark.read.parquet(f"{folder}/table/batch=0").collect()
    spark.createDataFrame(rows).write.mode("overwrite").parquet(f"{folder}/table/batch=0")
    assert len(rows) == 3 == s.job_status_table(spark, folder).count()


def test_request_rate_over_restarts(spark):
    calls = [(k, T0 + dt.timedelta(seconds=7 * i)) for i in range(60) for k in "ab"[: 1 + i % 2]]
    schema, folder = "key string, ts timestamp", tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    stream, source = start(spark, calls[:40], schema)
    for part in ([], calls[40:]):
        if part:
            add(spark, source, part, schema)
        sinks.upsert_stream(s.request_rate_stream(stream, 60, 30, 3), folder).awaitTermination()
    got = {(r.key, r.window_start): r.calls for r in sinks.latest(spark, folder, ["key", "window_start"]).collect()}
    want = {}
    for k, t in calls:
        for back in (0, 30):
            at = T0 + dt.timedelta(seconds=(t - T0).total_seconds() // 30 * 30 - back)
            want[k, at] = want.get((k, at), 0) + 1
    assert got == want


def test_live_windows(spark):
    rows = [(1, i, T0 + dt.timedelta(seconds=7 * i), T0 + dt.timedelta(seconds=7 * i + 9), "abc") for i in range(30)]
    schema = "video_id long, seg_id int, begin timestamp, finish timestamp, text string"
    stream, _ = start(spark, rows + rows[:3], schema)
    got = {r.window_start: (r.n_segments, r.first_seg, r.last_seg) for r in run(spark, s.live_windows(stream, 60.0, 20.0), "complete").collect()}
    want = {}
    base = int(T0.timestamp())
    for k in range((base - 60) // 40, (base + 300) // 40 + 1):
        inside = [r[1] for r in rows if r[3].timestamp() > k * 40 and r[2].timestamp() < k * 40 + 60]
        if inside:
            want[k * 40] = (len(inside), min(inside), max(inside))
    assert {int(k.timestamp()): v for k, v in got.items()} == want


def test_live_windows_close_in_append_mode(spark):
    """A window comes out once later segments have passed its end by the lateness; the open ones stay inside."""
    rows = [(1, i, T0 + dt.timedelta(seconds=7 * i), T0 + dt.timedelta(seconds=7 * i + 9), "abc") for i in range(60)]
    schema = "video_id long, seg_id int, begin timestamp, finish timestamp, text string"
    stream, _ = start(spark, rows + rows[:3], schema)
    got = run(spark, s.live_windows(stream, 60.0, 20.0, "60 seconds"), "append").collect()
    last = max(r[2].timestamp() for r in rows)
    assert got and len(got) == len({r.window_start for r in got})
    for r in got:
        k = r.window_start.timestamp()
        inside = [x[1] for x in rows if x[3].timestamp() > k and x[2].timestamp() < k + 60]
        assert k + 60 < last + 60 and (r.n_segments, r.first_seg, r.last_seg) == (len(inside), min(inside), max(inside))


def test_heartbeat_goes_on_after_a_restart(spark, rocksdb):
    """Beats come while a job runs; the restarted stream knows the jobs of the first run, and a finished one is silent."""
    stream, source = start(spark, ROWS, s.JOB_EVENT)
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")

    def run_for(seconds):
        q = sinks.upsert_stream(s.stale_jobs_stream(stream, 1.0), folder, processingTime="1 second")
        q.awaitTermination(seconds)
        q.stop()
        return spark.read.parquet(f"{folder}/table").collect()

    first = run_for(25)
    told = {r.job_id: r for r in first if not r.heartbeat}
    assert told[1].stage == "analyzing" and told[1].status == "processing" and told[1].stale_seconds > 0
    assert told[2].status == "error" and told[3].status == "paused_for_review"
    assert {r.job_id for r in first if r.heartbeat} == {1, 3}
    add(spark, source, MORE)
    seen = max(r.batch for r in first)
    second = [r for r in run_for(25) if r.batch > seen]
    told = {r.job_id: r for r in second if not r.heartbeat}
    assert told[1].status == "done" and told[3].stage == "review" and told[4].message == "same time"
    done = min(r.batch for r in second if r.job_id == 1 and not r.heartbeat)
    assert not [r for r in second if r.heartbeat and r.job_id == 1 and r.batch > done]
    assert {3, 4} <= {r.job_id for r in second if r.heartbeat}
