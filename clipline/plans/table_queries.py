"""Registered queries over copy, packages, job tables, sources and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import round_to
from ..functions.text import FILLER_TAGS, strip
from ..functions.times import minutes_text
from ..operators import candidates, jobs, packaging
from ..session import cut_lineage, ensure_checkpoint_dir
from ..sources import readers, responses
from ..sources.tables import conversation_segments, document_segments, event_job_log, event_spans, order_stage_runs, table
from ..streaming import jobs as streams
from ..streaming.sinks import append_stream, latest, upsert_stream
from .sql import SEGMENTS, SPANS, TURNS, WS, r3
from .transcript_queries import sql_list


# ---- copy and packages ------------------------------------------------------------------------------------------


def document_clips(spark, d):
    """One clip per document: its first sentence as title, its whole text as transcript, no tags of its own."""
    docs = table(spark, d, "documents")
    title = strip(F.split("text", r"(?<=[.!?])\s+")[0])
    return docs.select(
        F.col("doc_id").alias("video_id"), F.lit("clip_01").alias("clip_name"), title.alias("title"), F.lit("").alias("reason"), F.col("text").alias("transcript_text"),
        F.when(F.pmod("doc_id", F.lit(2)) == 0, F.col("source")).otherwise(F.lit("")).alias("description"), F.lit("").alias("caption"),
        F.when(F.pmod("doc_id", F.lit(3)) == 0, F.array(F.lit("#one"), F.lit("#two"))).otherwise(F.array().cast("array<string>")).alias("hashtags"),
        F.lit("a, b").alias("youtube_tags"), F.col("lang").alias("hook_phrase"),
    )


def q_topic_tags(spark, d):
    c = document_clips(spark, d)
    return c.select("video_id", F.array_join(packaging.topic_tags(F.col("title"), F.col("reason"), F.col("transcript_text")), " ").alias("tags"))


def document_copy(spark, d):
    """Copy for every second document, taken from its own words."""
    c = document_clips(spark, d).where(F.pmod("video_id", F.lit(2)) == 0)
    return c.select("video_id", "clip_name", F.concat(F.lit("About "), F.col("title")).alias("title"), F.lit("").alias("description"), F.concat("title", F.lit(" now")).alias("caption"), F.array(F.lit("#Topic"), F.lit("a b"), F.lit("#c"), F.lit("#d"), F.lit("#topic")).alias("hashtags"))


def q_normalize_copy(spark, d):
    out = packaging.normalize_copy(document_clips(spark, d), document_copy(spark, d))
    return out.select("video_id", "social_title", "social_description", "social_caption", F.array_join("hashtags", " ").alias("tags"), "generic")


def q_merge_tags(spark, d):
    c = document_clips(spark, d).withColumn("own", F.split(F.concat(F.lit("Talk "), F.col("hook_phrase"), F.lit(" #FYP #talk")), " "))
    return c.select("video_id", F.array_join(packaging.merge_tags(F.col("own")), " ").alias("merged"), F.array_join(packaging.strip_filler(F.col("own")), " ").alias("topical"))


def q_metadata_coverage(spark, d):
    c = document_clips(spark, d).withColumn("video_id", F.floor(F.col("video_id") / 7))
    return packaging.metadata_coverage(c)


def q_package_text(spark, d):
    return packaging.package_text(document_clips(spark, d)).select("video_id", "package")


def q_package_results(spark, d):
    """Plans of the documents over earlier results and copy, with the files a label row stands for."""
    plans = document_clips(spark, d).withColumns({"total_duration": F.length("transcript_text").cast("double"), "social_title": F.col("title"), "social_description": F.col("description"), "social_caption": F.lit("")})
    old = plans.where(F.pmod("video_id", F.lit(5)) == 0).select("video_id", "clip_name", F.lit("old").alias("social_description"), F.array(F.lit("#old")).alias("hashtags"))
    lab = table(spark, d, "labels").select(F.col("doc_id").alias("video_id"), F.lit("clip_01").alias("clip_name"), F.when(F.col("quality") == 1, "raw").otherwise("captioned").alias("kind"))
    out = packaging.package_results(plans, old, document_copy(spark, d), lab)
    return out.select("video_id", "duration", "social_description", "social_caption", F.array_join("hashtags", " ").alias("tags"), "has_raw", "has_captioned", "caption_failed")


def page_files(spark, d):
    """Pages as files: the host is the job, the page the clip."""
    p = table(spark, d, "pages").select("page_id", "url")
    host = F.regexp_extract("url", r"://([^/]+)", 1)
    return p.select(
        host.alias("video_id"), F.concat(F.lit("clip_"), F.pmod("page_id", F.lit(5)).cast("string")).alias("clip_name"), F.concat(F.lit("clips/"), F.col("page_id").cast("string"), F.when(F.pmod("page_id", F.lit(11)) == 0, "_branded").otherwise("")).alias("path"),
        F.lit("clips").alias("folder"), (F.pmod("page_id", F.lit(3)) == 0).alias("captioned"), F.concat(F.col("page_id").cast("string"), F.lit(".mp4")).alias("file"),
        F.element_at(F.array(F.lit(""), F.lit("bold_hooked"), F.lit("bold"), F.lit("thin")), (F.pmod("page_id", F.lit(4)) + 1).cast("int")).alias("suffix"), F.col("page_id").cast("double").alias("modified"),
    )


def q_discover_targets(spark, d):
    files = page_files(spark, d)
    plans = files.where("clip_name in ('clip_0', 'clip_1')").select("video_id", "clip_name").distinct()
    return packaging.discover_targets(plans, files)


def q_pick_variant(spark, d):
    out = packaging.pick_variant(page_files(spark, d), F.lit("Bold"))
    return out.select("video_id", "clip_name", "primary_file", F.size("variants").cast("bigint").alias("n_variants"))


# ---- jobs -------------------------------------------------------------------------------------------------------


def q_latest_stage(spark, d):
    out = jobs.latest_stage(order_stage_runs(spark, d), "run_id")
    return out.select("job_id", "stage", "status", "run_id", "amount")


def q_stale_stages(spark, d):
    runs = order_stage_runs(spark, d)
    half = F.pmod("run_id", F.lit(2)) == 0
    shape = lambda df: df.select("job_id", "stage", F.when(F.col("amount") < 250000, "low").otherwise("high").alias("settings_fp"), F.create_map(F.lit("status"), F.col("status")).alias("inputs"))
    return jobs.stale_stages(shape(jobs.latest_stage(runs.where(half), "run_id")), shape(jobs.latest_stage(runs.where(~half), "run_id")))


def q_pipeline_progress(spark, d):
    runs = jobs.latest_stage(order_stage_runs(spark, d), "run_id")
    weights = {"1-URGENT": 6, "2-HIGH": 10, "3-MEDIUM": 12, "4-NOT SPECIFIED": 4, "5-LOW": 34}
    return jobs.pipeline_progress(runs, weights, ("F",))


def q_missing_artifacts(spark, d):
    """An artifact is expected for every document and present for the labelled ones."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("job_id"), F.lit("plan.json").alias("path"), (F.pmod("doc_id", F.lit(2)) == 0).alias("is_json"))
    lab = table(spark, d, "labels").select(F.col("doc_id").alias("job_id"), F.lit("plan.json").alias("path"), F.when(F.col("toxic") == 1, 0).otherwise(10).alias("size"), F.when(F.col("quality") == 1, '{"a": 1}').otherwise("{broken").alias("content"))
    return jobs.missing_artifacts(docs, lab).select("job_id", "problem")


def q_log_tail(spark, d):
    lines = event_job_log(spark, d).withColumnRenamed("log_id", "line_no")
    return jobs.log_tail(lines, 5).select("job_id", "line_no", "stage")


def q_job_status(spark, d):
    e = event_job_log(spark, d).withColumn("stage", F.when(F.col("stage") == "purchase", "done").otherwise(F.col("stage")))
    return jobs.latest_status(e, "log_id").select("job_id", "stage", "status", "progress", "message")


def q_request_rate(spark, d):
    calls = event_job_log(spark, d).select(F.col("stage").alias("key"), F.col("log_id").alias("call_id"), "ts")
    return jobs.request_rate(calls, 3600, 5).select("key", "call_id", "calls_in_window", "over_limit")


# ---- streams over the given tables ------------------------------------------------------------------------------


def _stream_folder(spark: SparkSession, name: str) -> str:
    """A new folder for a stream's table and progress, in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}_{uuid.uuid4().hex[:12]}"


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return raw.select(
        F.col("user_id").alias("job_id"), F.when(F.col("event_type") == "purchase", "done").otherwise(F.col("event_type")).alias("stage"), F.col("value").cast("int").alias("progress"),
        F.col("props").alias("message"), F.col("ts").cast("timestamp").alias("ts"), "event_id",
    )


def q_job_status_stream(spark, d):
    folder = _stream_folder(spark, "job_status")
    streams.job_status_stream(_event_stream(spark, d), folder).awaitTermination()
    return streams.job_status_table(spark, folder).drop("updated_at")


def q_stale_jobs_stream(spark, d):
    """The last word of the heartbeat on each job; beats and seconds depend on the clock and are left out."""
    folder, conf = _stream_folder(spark, "stale_jobs"), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        # one batch: with timers waiting, a stream that is to read what is there never finds itself done
        upsert_stream(streams.stale_jobs_stream(_event_stream(spark, d)), folder, once=True).awaitTermination()
    finally:
        spark.conf.set(conf, before)
    return latest(spark, folder, ["job_id"]).select("job_id", "stage", "status", "progress", "message", "event_id")


def q_request_rate_stream(spark, d):
    """Calls per event type in hourly windows every half hour; open windows are in the table too, closed ones leave the state."""
    calls, folder = _event_stream(spark, d).withColumnRenamed("stage", "key"), _stream_folder(spark, "request_rate")
    upsert_stream(streams.request_rate_stream(calls, 3600, 1800, 5), folder).awaitTermination()
    return latest(spark, folder, ["key", "window_start"]).select("key", F.unix_seconds("window_start").alias("window_start"), "calls", "over_limit")


def q_live_windows(spark, d):
    """Sentences of the documents as a stream in four parts by time, then a tick far ahead that closes all windows.

    What comes out is cut at the last window of the finished transcript, as the batch form has it.
    """
    folder, width, overlap = _stream_folder(spark, "live_windows"), 120.0, 24.0
    s = cut_lineage(document_segments(spark, d).select("video_id", "seg_id", "start_s", "end_s", "text"))
    at = lambda c: F.timestamp_micros((F.col(c) * 1e6).cast("bigint"))
    timed = s.select("video_id", "seg_id", at("start_s").alias("begin"), at("end_s").alias("finish"), "text")
    edges = [0.0, 60.0, 300.0, 1500.0, float("inf")]
    for a, b in zip(edges, edges[1:], strict=False):
        timed.where((s["start_s"] >= a) & (s["start_s"] < b)).write.mode("append").parquet(f"{folder}/in")
    end = s.agg(F.max("end_s")).first()[0] or 0.0
    tick = spark.range(1).select(F.lit(-1).cast("bigint").alias("video_id"), F.lit(0).alias("seg_id"), F.lit(end + 1e5).alias("start_s"), F.lit(end + 1e5 + 1).alias("end_s"), F.lit("").alias("text"))
    tick.select("video_id", "seg_id", at("start_s").alias("begin"), at("end_s").alias("finish"), "text").write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(timed.schema).parquet(f"{folder}/in")
    append_stream(streams.live_windows(stream, width, overlap, "1 hour"), folder).awaitTermination()
    total = s.groupBy("video_id").agg(F.max_by("end_s", "seg_id").alias("__total"))
    out = spark.read.parquet(f"{folder}/table").join(total, "video_id").withColumn("window_start", F.unix_seconds("window_start"))
    return out.where((F.col("window_start") == 0) | (F.col("window_start") < F.col("__total") - overlap)).drop("__total")


# ---- sources ----------------------------------------------------------------------------------------------------


def document_responses(spark, d):
    """Model answers that quote documents: prose, then fenced JSON with a comment and trailing commas.

    A clip per line of the document that is not blank, its words, takeaway and score taken from that line; a document
    without such lines, and every tenth one, answers with a summary and no clips.
    """
    docs = table(spark, d, "documents").select("doc_id", F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), strip), lambda x: x != "").alias("lines"))
    quoted = lambda x: F.regexp_replace(F.to_json(F.array(x)), r"^\[|\]$", "")
    frame = lambda a, b: F.concat(F.lit("["), minutes_text(a), F.lit(" -> "), minutes_text(b), F.lit("]"))

    def clip(line, k):
        s = F.pmod(F.col("doc_id") * 7 + k * 41, F.lit(600)).cast("double")
        return F.concat(
            F.lit('{"youtube_title": "Clip '), F.col("doc_id").cast("string"), F.lit('", "hook_score": "'), F.pmod(F.length(line), F.lit(13)).cast("string"),
            F.lit('/10", "takeaway": '), quoted(line), F.lit(', "description_hashtags": "#a #b #A", // tags\n "segments": [{"start_words": '), quoted(line),
            F.lit(', "start_frame": "'), frame(s, s + 4.0), F.lit('", "end_words": "three", "end_frame": "'), frame(s + 30.0, s + 35.5), F.lit('"},]}'),
        )

    clips = F.array_join(F.transform("lines", clip), ",\n")
    none = (F.pmod("doc_id", F.lit(10)) == 0) | (F.size("lines") == 0)
    body = F.when(none, F.lit('{"window_summary": "nothing here"}')).otherwise(F.concat(F.lit('{"clips": ['), clips, F.lit(",]}")))
    return docs.select(F.floor(F.col("doc_id") / 8).alias("video_id"), F.col("doc_id").alias("ord"), F.concat(F.lit("Here is the result:\n```json\n"), body, F.lit("\n```\nDone {not json}.")).alias("raw"))


def q_parse_ai_responses(spark, d):
    raw, _ = responses.parse_ai_responses(document_responses(spark, d))
    out = candidates.normalize_candidates(raw)
    return out.select("video_id", "candidate_id", "title", "takeaway", "hook_score", "flow_score", F.array_join("hashtags", " ").alias("tags"), "start_s", "end_s")


def q_best_of(spark, d):
    """Two answers per task, the better filled one wins."""
    parsed = responses.extract_values(document_responses(spark, d)).select("video_id", F.floor(F.col("ord") / 40).alias("task"), "ord", F.transform("clips", lambda c: F.from_json(c, candidates.RAW_CANDIDATE)).alias("candidates"))
    best = candidates.best_of(parsed, ["video_id", "task"], candidates.response_quality(F.col("candidates")), "ord")
    return best.select("video_id", "task", "ord")


def q_canonical_url(spark, d):
    """Addresses of the pages in the forms a video id comes in."""
    p = table(spark, d, "pages")
    vid = F.substring(F.md5("url"), 1, 11)
    n = F.pmod("page_id", F.lit(5))
    url = (
        F.when(n == 0, F.concat(F.lit("https://youtu.be/"), vid, F.lit("?t=3"))).when(n == 1, F.concat(F.lit("https://www.youtube.com/watch?list=x&v="), vid, F.lit("&pp=1")))
        .when(n == 2, F.concat(F.lit("https://m.youtube.com/shorts/"), vid)).when(n == 3, F.concat(F.lit("https://youtube.com/embed/"), vid, F.lit("?si=q"))).otherwise(F.col("url"))
    )
    return p.select("page_id", readers.canonical_url(url).alias("canonical"))


def q_diarization(spark, d):
    """Turns of the conversations written as both kinds of document and read back."""
    s = conversation_segments(spark, d)
    turn = F.to_json(F.struct(F.col("start_s").alias("begin"), F.col("end_s").alias("end"), F.col("speaker").alias("label")))
    listed = s.where(F.pmod("video_id", F.lit(2)) == 0).groupBy("video_id").agg(F.concat(F.lit("["), F.array_join(F.collect_list(turn), ","), F.lit("]")).alias("json"))
    spans = s.where(F.pmod("video_id", F.lit(2)) == 1).groupBy("video_id", "speaker").agg(F.collect_list(F.array("start_s", "end_s")).alias("ivs"))
    mapped = spans.groupBy("video_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("speaker", "ivs")))).alias("json"))
    out = readers.parse_diarization(listed.unionByName(mapped))
    return out.select("video_id", round_to(F.col("start_s")).alias("start_s"), round_to(F.col("end_s")).alias("end_s"), "speaker")


def q_loudness(spark, d):
    """Events written as meter lines and read back."""
    e = event_spans(spark, d)
    line = F.concat(F.lit("[meter] t: "), F.round("start_s", 2).cast("string"), F.lit("  TARGET:-23 LUFS  M: "), F.when(F.col("speaker") == "error", "-inf").otherwise(F.concat(F.lit("-"), F.col("score").cast("string"))), F.lit(" S: -20.1"))
    out = readers.parse_loudness(e.select(F.col("video_id").alias("track_id"), line.alias("value")))
    return out.groupBy("track_id").agg(F.count("*").alias("n"), round_to(F.sum("lufs")).alias("lufs"))


def q_candidate_audit(spark, d):
    """Audit texts of the conversations, a block per turn, read back."""
    s = conversation_segments(spark, d)
    block = F.concat(
        F.lit("["), F.format_string("%03d", F.col("seg_id") + 1), F.lit("] w01_c"), F.format_string("%02d", F.col("seg_id") + 1), F.lit("\nTitle: by "), F.col("speaker"),
        F.lit("\nscores: hook="), F.pmod("seg_id", F.lit(10)).cast("string"), F.lit(".5, viral=7\nseg_1_start_words: "), F.regexp_replace(F.col("text"), r"[\s:]+", " "), F.lit("\nseg_2_end_words: end\n"), F.lit("-" * 12), F.lit("\n"),
    )
    docs = s.groupBy("video_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seg_id", block.alias("b")))), lambda x: x["b"]), "").alias("text"))
    out = readers.parse_audit(docs)
    return out.select("video_id", "candidate_id", "title", "hook_score", "flow_score", "virality_score", F.size("segments").cast("bigint").alias("n_parts"), F.trim(F.col("segments")[0]["start_words"]).alias("start_words"))


QUERIES = {
    "topic_tags": q_topic_tags, "normalize_copy": q_normalize_copy, "merge_tags": q_merge_tags, "metadata_coverage": q_metadata_coverage,
    "package_text": q_package_text, "package_results": q_package_results, "discover_targets": q_discover_targets, "pick_variant": q_pick_variant,
    "latest_stage": q_latest_stage, "stale_stages": q_stale_stages, "pipeline_progress": q_pipeline_progress, "missing_artifacts": q_missing_artifacts,
    "log_tail": q_log_tail, "job_status": q_job_status, "request_rate": q_request_rate, "job_status_stream": q_job_status_stream,
    "request_rate_stream": q_request_rate_stream, "stale_jobs_stream": q_stale_jobs_stream, "live_windows": q_live_windows, "parse_ai_responses": q_parse_ai_responses, "best_of": q_best_of, "canonical_url": q_canonical_url,
    "diarization": q_diarization, "loudness": q_loudness, "candidate_audit": q_candidate_audit,
}

LATEST = "lt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders {where}) WHERE r = 1)"
HOST = "regexp_extract(url, '://([^/]+)', 1)"
FILES = f"""f AS (SELECT {HOST} AS video_id, 'clip_' || CAST(page_id % 5 AS VARCHAR) AS clip_name, 'clips/' || CAST(page_id AS VARCHAR) || CASE WHEN page_id % 11 = 0 THEN '_branded' ELSE '' END AS path, page_id % 3 = 0 AS cap, page_id FROM pages)"""
TITLE = r"trim(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))[1], ' ' || chr(9) || chr(10) || chr(13))"

RESPONSE_LINES = f"""l AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, {WS})), lambda x: x <> '') AS lines FROM documents)"""

ORACLES = {
    "topic_tags": f"""WITH w AS (SELECT doc_id, lower(u.x) AS x, u.i FROM documents, unnest(regexp_extract_all({TITLE} || '  ' || text, '[A-Za-z][A-Za-z0-9]{{3,}}')) WITH ORDINALITY AS u(x, i)),
 o AS (SELECT doc_id, '#' || substr(x, 1, 24) AS t, min(i) AS i FROM w WHERE x NOT IN ({sql_list(packaging.STOPWORDS)}) GROUP BY 1, 2),
 n AS (SELECT doc_id, t, i FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM o) WHERE r <= 9),
 pool AS (SELECT doc_id, u.t, 1000000 + u.i AS i FROM documents, unnest([{sql_list(packaging.TOPIC_POOL)}]) WITH ORDINALITY AS u(t, i)),
 al AS (SELECT doc_id, t, min(i) AS i FROM (SELECT * FROM n UNION ALL SELECT * FROM pool) GROUP BY 1, 2),
 l AS (SELECT doc_id, list(t ORDER BY i) AS l FROM al GROUP BY 1)
 SELECT doc_id AS video_id, array_to_string(list_concat(list_concat(l[1:len(l) - 1], list_transform(range(0, greatest(0, 12 - len(l))), lambda k: '#content')), l[len(l):len(l)])[1:15], ' ') AS tags FROM l""",
    "metadata_coverage": """SELECT doc_id // 7 AS video_id, count(*) FILTER (WHERE doc_id % 6 = 0 AND source <> '') AS n_full, count(*) AS n_clips, count(*) FILTER (WHERE doc_id % 6 = 0 AND source <> '') >= greatest(1, count(*) // 2) AS covered FROM documents GROUP BY 1""",
    "package_text": f"""SELECT doc_id AS video_id, '=== TITLE ===' || chr(10) || trim({TITLE}, ' ' || chr(9) || chr(10) || chr(13)) || chr(10) || chr(10) || '=== DESCRIPTION ===' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN source ELSE '' END ||
  CASE WHEN doc_id % 3 = 0 THEN chr(10) || chr(10) || '#one #two' ELSE '' END || chr(10) || chr(10) || '=== TAGS (comma-separated) ===' || chr(10) || 'a, b' || chr(10) || chr(10) || '=== TTS HOOK ===' || chr(10) || lang || chr(10) AS package FROM documents""",
    "merge_tags": f"""WITH t AS (SELECT doc_id, u.x, u.i FROM documents, unnest(list_concat(['#Talk', '#' || lang, '#FYP', '#talk'], string_split('{FILLER_TAGS}', ' '))) WITH ORDINALITY AS u(x, i)),
 f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(x) ORDER BY i) AS r FROM t)
 SELECT doc_id AS video_id, string_agg(x, ' ' ORDER BY i) AS merged, any_value('Talk ' || lang || ' #talk') AS topical FROM f JOIN documents USING (doc_id) WHERE r = 1 GROUP BY 1""",
    "discover_targets": f"""WITH {FILES}, c AS (SELECT video_id, clip_name, max(path) AS path FROM f WHERE cap GROUP BY 1, 2),
 k AS (SELECT *, CASE WHEN clip_name IN ('clip_0', 'clip_1') THEN 'plan' ELSE 'file' END AS source FROM c)
 SELECT video_id, clip_name, path, source FROM k UNION ALL SELECT video_id, 'clips__' || clip_name, min(path), 'external' FROM f WHERE path NOT LIKE '%\\_branded%' ESCAPE '\\' AND video_id NOT IN (SELECT video_id FROM k) GROUP BY 1, 2""",
    "pick_variant": f"""WITH {FILES}, v AS (SELECT *, ['', 'bold_hooked', 'bold', 'thin'][page_id % 4 + 1] AS sx FROM f), r AS (SELECT *, CASE sx WHEN 'bold_hooked' THEN 0 WHEN 'bold' THEN 1 ELSE 3 END AS k FROM v),
 n AS (SELECT *, row_number() OVER (PARTITION BY video_id, clip_name ORDER BY k, CASE WHEN k < 3 THEN 0 ELSE -page_id END, CAST(page_id AS VARCHAR) || '.mp4') AS rn, count(*) OVER (PARTITION BY video_id, clip_name) AS c FROM r)
 SELECT video_id, clip_name, CAST(page_id AS VARCHAR) || '.mp4' AS primary_file, c AS n_variants FROM n WHERE rn = 1""",
    "latest_stage": f"WITH {LATEST.format(where='')} SELECT o_custkey AS job_id, o_orderpriority AS stage, o_orderstatus AS status, o_orderkey AS run_id, o_totalprice AS amount FROM lt",
    "stale_stages": f"""WITH {LATEST.format(where='WHERE o_orderkey % 2 = 0').replace('lt AS', 'a AS')}, {LATEST.format(where='WHERE o_orderkey % 2 = 1').replace('lt AS', 'b AS')},
 j AS (SELECT a.o_custkey AS job_id, a.o_orderpriority AS stage, CASE WHEN b.o_custkey IS NULL THEN 'no previous stage state' WHEN a.o_orderstatus <> b.o_orderstatus THEN 'input artifacts changed' WHEN (a.o_totalprice < 250000) <> (b.o_totalprice < 250000) THEN 'settings fingerprint changed' ELSE 'unchanged' END AS reason
  FROM a LEFT JOIN b ON a.o_custkey = b.o_custkey AND a.o_orderpriority = b.o_orderpriority) SELECT job_id, stage, reason <> 'unchanged' AS stale, reason FROM j""",
    "pipeline_progress": f"""WITH {LATEST.format(where='')}, w AS (SELECT *, CASE o_orderpriority WHEN '1-URGENT' THEN 6 WHEN '2-HIGH' THEN 10 WHEN '3-MEDIUM' THEN 12 WHEN '4-NOT SPECIFIED' THEN 4 ELSE 34 END AS w FROM lt)
 SELECT o_custkey AS job_id, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN w ELSE 0 END) * 100 // 66 AS INTEGER) AS percent, count(*) FILTER (WHERE o_orderstatus = 'F') AS stages_done FROM w GROUP BY 1""",
    "missing_artifacts": """SELECT d.doc_id AS job_id, CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN toxic = 1 THEN 'empty' ELSE 'invalid_json' END AS problem FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL OR toxic = 1 OR (d.doc_id % 2 = 0 AND quality <> 1)""",
    "log_tail": "SELECT job_id, line_no, stage FROM (SELECT user_id AS job_id, event_id AS line_no, event_type AS stage, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 5",
    "job_status": """SELECT user_id AS job_id, stage, CASE stage WHEN 'done' THEN 'done' WHEN 'error' THEN 'error' ELSE 'processing' END AS status, progress, message FROM
 (SELECT user_id, CASE WHEN event_type = 'purchase' THEN 'done' ELSE event_type END AS stage, CAST(trunc(value) AS INTEGER) AS progress, props AS message, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""",
    "request_rate": """WITH c AS (SELECT event_type AS key, event_id AS call_id, epoch_us(ts) AS us FROM events),
 n AS (SELECT key, call_id, count(*) OVER (PARTITION BY key ORDER BY us RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS n FROM c) SELECT key, call_id, n AS calls_in_window, n > 5 AS over_limit FROM n""",
    "request_rate_stream": """WITH c AS (SELECT CASE WHEN event_type = 'purchase' THEN 'done' ELSE event_type END AS key, epoch_us(ts) // 1800000000 AS h FROM events), w AS (SELECT key, h * 1800 AS s FROM c UNION ALL SELECT key, (h - 1) * 1800 FROM c)
 SELECT key, CAST(s AS BIGINT) AS window_start, count(*) AS calls, count(*) > 5 AS over_limit FROM w GROUP BY 1, 2""",
    "parse_ai_responses": f"""WITH {RESPONSE_LINES},
 v AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id // 8 ORDER BY doc_id) AS w, lines FROM l WHERE doc_id % 10 <> 0 AND len(lines) > 0),
 c AS (SELECT doc_id, w, unnest(lines) AS line, unnest(range(len(lines))) AS k FROM v)
 SELECT doc_id // 8 AS video_id, 'w' || CASE WHEN w < 10 THEN '0' ELSE '' END || CAST(w AS VARCHAR) || '_c' || CASE WHEN k < 9 THEN '0' ELSE '' END || CAST(k + 1 AS VARCHAR) AS candidate_id,
  'Clip ' || CAST(doc_id AS VARCHAR) AS title, substr(line, 1, 280) AS takeaway, least(10.0::DOUBLE, (length(line) % 13)::DOUBLE) AS hook_score, 5.0::DOUBLE AS flow_score, '#a #b' AS tags,
  ((doc_id * 7 + k * 41) % 600)::DOUBLE AS start_s, ((doc_id * 7 + k * 41) % 600)::DOUBLE + 35.5::DOUBLE AS end_s FROM c""",
    "best_of": f"""WITH {RESPONSE_LINES}, v AS (SELECT doc_id // 8 AS video_id, doc_id // 40 AS task, doc_id AS ord, CASE WHEN doc_id % 10 = 0 THEN 0 ELSE len(lines) END AS q FROM l) SELECT video_id, task, ord FROM (SELECT *, row_number() OVER (PARTITION BY video_id, task ORDER BY q DESC, ord) AS r FROM v) WHERE r = 1""",
    "canonical_url": "SELECT page_id, CASE WHEN page_id % 5 = 4 THEN url ELSE 'https://www.youtube.com/watch?v=' || substr(md5(url), 1, 11) END AS canonical FROM pages",
    "diarization": f"WITH {TURNS} SELECT video_id, {r3('start_s')} AS start_s, {r3('end_s')} AS end_s, speaker FROM seg WHERE end_s > start_s",
    "loudness": f"WITH {SPANS} SELECT video_id AS track_id, count(*) AS n, {r3('sum(CASE WHEN speaker = ' + chr(39) + 'error' + chr(39) + ' THEN -120.0 ELSE -score END)')} AS lufs FROM span GROUP BY 1",
    "candidate_audit": r"""SELECT conv_id AS video_id, 'w01_c' || lpad(CAST(turn + 1 AS VARCHAR), 2, '0') AS candidate_id, 'by ' || role AS title, (turn % 10)::DOUBLE + 0.5::DOUBLE AS hook_score, 5.0::DOUBLE AS flow_score, 7.0::DOUBLE AS virality_score, CAST(2 AS BIGINT) AS n_parts,
 trim(regexp_replace(text, '[\s:]+', ' ', 'g')) AS start_words FROM conversations""",
}
ORACLES["job_status_stream"] = ORACLES["job_status"]
ORACLES["stale_jobs_stream"] = ORACLES["job_status"].replace("progress, message FROM\n", "progress, message, event_id FROM\n").replace("props AS message, row", "props AS message, event_id, row")
ORACLES["live_windows"] = f"""WITH {SEGMENTS},
 s2 AS (SELECT video_id, seg_id, trunc(start_s * 1000000.0::DOUBLE) / 1000000.0::DOUBLE AS a, trunc(end_s * 1000000.0::DOUBLE) / 1000000.0::DOUBLE AS b, length(text) AS n, arg_max(end_s, seg_id) OVER (PARTITION BY video_id) AS total FROM seg)
 SELECT video_id, count(*) AS n_segments, CAST(sum(n) AS BIGINT) AS n_chars, min(seg_id) AS first_seg, max(seg_id) AS last_seg, CAST(96 * u.k AS BIGINT) AS window_start
 FROM s2, unnest(range(0, CAST(floor(b / 96.0) AS BIGINT) + 1)) AS u(k) WHERE b > u.k * 96.0 AND a < u.k * 96.0 + 120.0 AND (u.k = 0 OR u.k * 96.0 < total - 24.0) GROUP BY video_id, u.k"""
