"""Cases that showed only on larger tables: sides that grow when they are cut up, rounded bounds, rare words."""

import random
import re

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from clipline.functions.text import strip
from clipline.operators import align, captions, jobs, media, scenes, similarity, speakers
from clipline.operators.intervals import interval_join
from clipline.plans.registry import ORACLES, QUERIES
from clipline.sources.tables import bounded_tasks, document_segments


def final_plan(df):
    """The plan as it was run, with what was decided on the way."""
    qe = df._jdf.queryExecution()
    qe.toRdd().count()
    return qe.executedPlan().toString().split("== Initial Plan ==")[0]


def test_generated_spans_are_never_broadcast(spark):
    """one row per key becomes 2,000 spans; by the rows before that Spark would broadcast them."""
    few = spark.range(20).groupBy("id").agg(F.max("id").alias("m"))
    many = few.select("id", F.explode(F.sequence(F.lit(0), F.lit(1999))).alias("k")).select("id", F.col("k").cast("double").alias("a")).withColumn("b", F.col("a") + 5.0)
    points = spark.range(40).select((F.col("id") % 20).alias("id"), (F.col("id") * 10.0).alias("t")).withColumn("t2", F.col("t"))
    joined = interval_join(many, points, ["id"], ("a", "b"), ("t", "t2"))
    assert "BroadcastExchange" not in final_plan(joined)
    assert joined.count() == sum(1 for i in range(40) for a in range(2000) if a < i * 10 < a + 5)


def test_energy_windows_against_loops(spark):
    rng = random.Random(5)
    loud = [(t, round(rng.uniform(0, 300), rng.choice([0, 2])), round(rng.uniform(-45, -5), 2)) for t in range(4) for _ in range(60)]
    length = {0: 300.0, 1: 25.0, 2: 280.5, 3: 7.0}
    df = spark.createDataFrame(loud, "track_id long, t_s double, lufs double")
    got = media.energy_windows(df, spark.createDataFrame(list(length.items()), "track_id long, duration_s double"))
    plan = final_plan(got)
    assert "Exchange hashpartitioning(track_id#" in plan and "w_start" not in "".join(x for x in plan.split("\n") if "Exchange hashpartitioning" in x)
    want = {}
    for track, dur in length.items():
        end = max(0.0, dur - 10.0)
        a, z = (10.0, end) if end > 18.0 else (0.0, dur)
        k = 0
        while a + k < z - 8.0:
            for n in (8.0, 12.0, 16.0, 20.0, 24.0):
                s, e = a + k, a + k + n
                inside = [(t, v) for x, t, v in loud if x == track and s <= t <= e]
                if e > z or not inside or max(v for _, v in inside) < -40:
                    continue
                mean = lambda xs: sum(xs) / len(xs) if xs else -120.0
                first, last = mean([v for t, v in inside if t <= s + n * 0.2]), mean([v for t, v in inside if t >= s + n * 0.8])
                peak, avg = max(v for _, v in inside), mean([v for _, v in inside])
                kind = "rise" if last > first + 3.0 and peak > -25.0 else "sustain" if avg > -22.0 else None
                if kind:
                    want[track, s, e] = (kind, peak)
            k += 1
    assert {(r.track_id, r.start_s, r.end_s): (r.kind, r.peak_vol) for r in got.collect()} == want


def test_refine_cut_measures_the_distance(spark):
    """frames whose distance rounds to the radius, though the rounded bounds leave them out, and the other way round."""
    rng = random.Random(1)
    pairs = []
    while len(pairs) < 200:
        c = rng.uniform(0, 100)
        f = c + rng.choice([-20.0, 20.0]) * (1 + rng.choice([0, 1e-16, -1e-16, 3e-16]))
        if (abs(f - c) <= 20.0) != (c - 20.0 <= f <= c + 20.0):
            pairs.append((len(pairs), c, f))
    cuts = spark.createDataFrame([(i, c) for i, c, _ in pairs], "video_id long, t_s double")
    frames = spark.createDataFrame([(i, f, 5.0, 0.5) for i, _, f in pairs], "video_id long, t_s double, mad double, hist_diff double")
    got = {r.video_id: r.refined_s for r in scenes.refine_cut(cuts, frames, 20.0).collect()}
    assert got == {i: round(f if abs(f - c) <= 20.0 else c, 4) for i, c, f in pairs}


def test_emphasize_words_on_rare_words(spark, tmp_path):
    """keywords among a conversation's own words that the small tables do not hold."""
    rows = [(1, 0, "user", "a dollar and time for money cash win Dollar! growth"), (1, 1, "assistant", "idea love cash. fire")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["emphasize_words"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    assert sorted(map(tuple, got.select("video_id", "word_idx", "word").collect())) == sorted(con.execute(ORACLES["emphasize_words"]).fetchall())


def test_document_words_are_dealt_by_size(spark, tmp_path):
    """F9 and all queries over documents: more text, more tasks; and edges of words need one shuffle, of texts."""
    text = lambda n, k: " ".join(str(random.Random(n * 1000 + i).random()) for i in range(k))
    for name, k in (("little", 2), ("much", 4000)):
        rows = [(n, text(n, k)) for n in range(400)]
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/{name}/documents.parquet")
    few, many = (document_segments(spark, f"{tmp_path}/{name}").rdd.getNumPartitions() for name in ("little", "much"))
    assert few == spark.sparkContext.defaultParallelism and many > 1.5 * few
    plan = final_plan(QUERIES["snap_end"](spark, f"{tmp_path}/little"))
    assert "Join" not in plan and plan.count("Exchange") == 1


def test_candidates_of_documents_stay_with_their_video(spark, tmp_path):
    """F3 and the queries that keep segments: after the texts are dealt by video no join, window or grouping moves rows again."""
    rows = [(n, " ".join(f"Sentence {i} of text {n} says a few plain words." for i in range(40 + n))) for n in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("filter_and_score", "candidate_text", "context_lines", "anchor_summary", "word_exact_text", "forward_trim_weak_start"):
        assert "Exchange hashpartitioning" not in final_plan(QUERIES[name](spark, str(tmp_path))), name


def test_words_of_documents_are_neither_shuffled_nor_kept(spark, tmp_path):
    """words read back are numbered in the row of their transcript; punctuation shuffles texts and stops, not words."""
    rows = [(n, " ".join(f"sentence {i} of text {n} says a few plain words without an end" for i in range(8 + n))) for n in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert "Exchange" not in final_plan(QUERIES["read_transcripts"](spark, str(tmp_path)))
    plan = final_plan(QUERIES["restore_punctuation"](spark, str(tmp_path)))
    assert "Scan ExistingRDD" not in "".join(x for x in plan.split("\n") if ",word#" in x)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = QUERIES["read_transcripts"](spark, str(tmp_path))
    names = ", ".join(f'"{c}"' for c in got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(f"select {names} from ({ORACLES['read_transcripts']})").fetchall())


def test_letter_pairs_stay_with_their_video(spark, tmp_path, monkeypatch):
    """after the texts are dealt by video the letter pairs of their sentences are neither shuffled nor broadcast, in any round."""
    rows = [(n, " ".join(f"Sentence {i % 50} of text {n % 3} says a few plain words {'and' * (i % 3)}." for i in range(90 + n))) for n in range(4)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plans, cut = [], similarity.cut_lineage_in_place
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(similarity, "cut_lineage_in_place", lambda df: plans.append(plan(df)) or cut(df))
    query = QUERIES["similarity_dedupe"]
    query(spark, str(tmp_path))
    pairs = plans[1]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        query(spark, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastExchange" not in pairs and len(plans) > 10
    assert not [x for x in pairs.split("\n") if "Exchange" in x]
    assert not [p for p in plans if re.search(r"Exchange hashpartitioning\([^\n]*__g#", p)]


def test_sentences_are_made_once(spark, tmp_path):
    """branches over the sentences of documents read them back where they are; the texts are taken apart once."""
    rows = [(n, " ".join(f"Sentence {i} of text {n} says a few plain words." for i in range(40 + n))) for n in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("clean_walks", "accept_verified"):
        assert "Exchange" not in final_plan(QUERIES[name](spark, str(tmp_path))).replace("BroadcastExchange", ""), name


def test_strip_reads_the_ends_only(spark):
    """all white space of Unicode goes from both ends, without a pattern that is tried at every character."""
    df = spark.createDataFrame([(chr(i), i) for i in range(0x3100)], "c string, i int")
    text = F.concat(F.col("c"), F.lit("a b"), F.col("c"), F.lit(" "))
    both = df.select(strip(text).alias("n"), F.regexp_replace(text, r"(?U)^\s+|\s+$", "").alias("o"))
    assert both.where("n <> o").count() == 0 and both.where("n = 'a b'").count() == 25
    assert "regexp" not in both.select("n")._jdf.queryExecution().optimizedPlan().toString()


def test_edited_texts_are_matched_one_at_a_time():
    """F16: what Python holds and hands on at once does not grow with the texts of a batch."""
    old = [[f"w{(i * 7 + n) % 90}" for i in range(100)] for n in range(400)]
    new = [[w + "x" if i % 7 == 3 else w for i, w in enumerate(o) if i % 11 != 5] for o in old]
    batch = pa.RecordBatch.from_pydict({"video_id": list(range(400)), "clip_name": ["clip_01"] * 400, "new_tokens": new, "old_words": old})
    got = list(captions._matched_tokens(iter([batch])))
    assert len(got) > 1 and max(b.num_rows for b in got) < captions.TOKEN_ROWS + 100
    rows = [r for b in got for r in b.to_pylist()]
    assert [r["word"] for r in rows] == [w for n in new for w in n]
    assert all(old[r["video_id"]][r["old_no"]] == r["word"] for r in rows if r["old_no"] >= 0)
    assert all(r["old_no"] >= 0 for r in rows if not r["word"].endswith("x"))


def test_busy_hours_are_counted_once(spark):
    """a count runs along the calls of a key instead of walking each call's window anew; ties and windows that end in a block included."""
    rng = random.Random(23)
    for seconds in (20, 60, 90):
        rows = [(f"k{i % 2}", i, rng.randrange(0, 400) * 500_000) for i in range(500)]
        calls = spark.createDataFrame(rows, "key string, call_id long, us long").select("key", "call_id", F.timestamp_micros("us").alias("ts"))
        out = jobs.request_rate(calls, seconds, 5)
        assert "unboundedpreceding" in out._jdf.queryExecution().executedPlan().toString()
        want = [sum(k == key and us - seconds * 1_000_000 < u <= us for k, _, u in rows) for key, _, us in rows]
        got = {r.call_id: (r.calls_in_window, r.over_limit) for r in out.collect()}
        assert [got[i] for i in range(500)] == [(n, n > 5) for n in want]


def test_phrases_are_found_where_the_words_are(spark, tmp_path):
    """phrases are looked up among neighbouring words of their video, so words are neither counted, shuffled nor kept."""
    rows = [(n, " ".join(f"Sentence {i} of text {n} says a few plain words." for i in range(40 + n))) for n in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    items = [(n, f"Sentence {n} of text {n} says a few plain words. Sentence {n + 1} of text {n} says a few") for n in range(5)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name in ("align_phrases", "resolve_boundaries"):
        found = QUERIES[name](spark, str(tmp_path))
        plan = final_plan(found)
        assert "REPARTITION_BY_NUM" in plan and not re.search(r"Exchange hashpartitioning[^\n]*ENSURE_REQUIREMENTS", plan), name
        assert found.count() > 0


def test_phrases_of_any_length_and_share(spark):
    rng = random.Random(3)
    words = [(v, i, rng.choice("aabcdef")) for v in range(3) for i in range(60)]
    phrases = [(k, " ".join(rng.choice("aabcdef") for _ in range(k % 11 + 1))) for k in range(33)]
    w, a = spark.createDataFrame(words, "video_id int, word_idx int, clean string"), spark.createDataFrame(phrases, "anchor_id int, phrase string")
    for least, large in ((0.4, None), (0.7, False), (1.0, False)):
        got = sorted((r.video_id, r.anchor_id, r.start_idx, round(r.ratio, 6)) for r in align.phrase_matches(a, w, [], least, large).collect())
        want = []
        for v in range(3):
            mine = [x[2] for x in words if x[0] == v]
            for k, phrase in phrases:
                toks = phrase.split()
                for s in range(len(mine) - len(toks) + 1):
                    r = sum(x == y for x, y in zip(toks, mine[s:], strict=False)) / len(toks)
                    want += [(v, k, s, round(r, 6))] if r >= least else []
        assert got == sorted(want)


def test_clips_of_documents_stay_with_their_video(spark, tmp_path):
    """what is kept between the jobs of ranking and selecting stays spread by video, words are not kept at all."""
    rows = [(n, " ".join(f"Sentence {i} of text {n} says a few plain words." for i in range(40 + n))) for n in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(n, 0, n % 2) for n in range(12)], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for name in ("rank_windows", "select_clips"):
        assert "Exchange hashpartitioning" not in final_plan(QUERIES[name](spark, str(tmp_path))), name


def test_speakers_are_named_once_in_bounded_tasks(spark):
    """the steps of the selection read the few pairs of a video; shuffles have more parts for a larger table."""
    turns = spark.createDataFrame([(v, 10.0 * i, 10.0 * i + 9.0, "ab"[i % 2]) for v in range(3) for i in range(8)], "video_id int, start_s double, end_s double, speaker string")
    seen = turns.select("video_id", F.xxhash64("start_s").alias("seg_index"), "start_s", "end_s", F.lit(0.5).alias("confidence"), F.concat(F.lit("face_"), "speaker").alias("visual_speaker"))
    got = speakers.map_speakers(seen.withColumn("is_wide", F.lit(False)), turns)
    assert "last_turn" not in final_plan(got)
    assert sorted((r.video_id, r.speaker, r.visual_speaker) for r in got.collect()) == [(v, s, f"face_{s}") for v in range(3) for s in "ab"]
    names = ("spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    before = [spark.conf.get(n, None) for n in names]
    try:
        bounded_tasks(spark.range(1_000_000))
        assert int(spark.conf.get(names[0])) == max(int(spark.conf.get("spark.sql.shuffle.partitions")), 16)
    finally:
        for name, value in zip(names, before, strict=True):
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
