"""Caption tables: words moved to clip time, paired into lines, edited, numbered."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import round_to
from ..functions.text import strip, tokens
from ..functions.times import subtitle_stamp
from .intervals import interval_join
from .ordered import block_if, last_seen, lead, next_seen, position, row_block, running_sum, sum_before, time_block, with_ordered
from .scan import since_reset

# Line widths, shortest reveals, the join overlap and the keyword symbols.
LINE_CHARS = 12
PAIR_CHARS = 18
REVEAL_GAP_S = 0.16
MIN_CAPTION_S = 0.2
MIN_SECOND_S = 0.12
MIN_WORD_S = 0.08
MANIFEST_TOLERANCE_S = 0.05
CROSSFADE_FRAMES = 5
TOKEN_ROWS = 16384  # tokens that are handed on at once
KEYWORD_SYMBOLS = {
    "money": "💰", "cash": "💰", "dollar": "💵", "fire": "🔥", "growth": "🚀", "rocket": "🚀", "heart": "❤️",
    "love": "❤️", "win": "🏆", "winner": "🏆", "lose": "❌", "success": "✅", "cool": "😎", "brain": "🧠", "idea": "💡",
    "light": "💡", "time": "⏱️",
}
DASHES = r"[-‐‑‒–—―−]"
CAPTION_PUNCTUATION = r"(?:(?<!\p{Nd})[.,:]|[.,:](?!\p{Nd}))|[^\p{L}\p{N}_\s$%+&#@/'’.,:*]"


def strip_punctuation(c: Column) -> Column:
    """Sentence punctuation and dashes out; numbers, currency and percent stay."""
    bare = F.regexp_replace(F.regexp_replace(c, DASHES, " "), CAPTION_PUNCTUATION, "")
    return F.trim(F.regexp_replace(F.replace(bare, F.lit("_"), F.lit("")), r"(?U)\s+", " "))


def word_case(c: Column, case: str) -> Column:
    bare = strip_punctuation(c)
    return {"lower": F.lower, "title": F.initcap, "natural": lambda x: x}.get(case, F.upper)(bare)


def render_offsets(rendered: DataFrame, crossfade: bool = True) -> DataFrame:
    """Playback offset of each part: seconds rendered before it, less one crossfade per join.

    rendered (video_id, clip_name, part, rendered_s, fps).
    """
    key = ["video_id", "clip_name"]
    join_s = F.lit(float(max(1, CROSSFADE_FRAMES))) / F.greatest(F.lit(1.0), F.coalesce("fps", F.lit(30.0))) if crossfade else F.lit(0.0)
    placed = with_ordered(
        rendered, key, ["part"],
        {"__before": sum_before(F.greatest(F.lit(0.0), F.col("rendered_s"))), "__n": sum_before(F.lit(1))},
    )
    return placed.withColumn("offset_s", round_to(F.col("__before") - F.col("__n") * join_s, 4)).drop("__before", "__n")


def _part_bases(plans: DataFrame, manifest: DataFrame | None) -> DataFrame:
    """Parts with where each begins in clip time: seconds of the parts before it, or the manifest's offset."""
    before = F.aggregate(
        F.slice("segments", F.lit(1), F.col("part")), F.lit(0.0),
        lambda s, p: s + F.greatest(F.lit(0.0), p["end_s"] - p["start_s"]),
    )
    parts = plans.select("video_id", "clip_name", "segments", F.posexplode("segments").alias("part", "__p")).select(
        "video_id", "clip_name", "part", F.col("__p.start_s").alias("p_start"), F.col("__p.end_s").alias("p_end"), before.alias("base_s")
    )
    if manifest is None:
        return parts
    m = manifest.select("video_id", "clip_name", F.col("source_start").alias("__ms"), F.col("source_end").alias("__me"), "offset_s", F.col("part").alias("__mp"))
    near = (F.abs(F.col("__ms") - F.col("p_start")) <= MANIFEST_TOLERANCE_S) & (F.abs(F.col("__me") - F.col("p_end")) <= MANIFEST_TOLERANCE_S)
    hit = parts.join(m, ["video_id", "clip_name"]).where(near).groupBy("video_id", "clip_name", "part").agg(F.min_by("offset_s", "__mp").alias("__off"))
    return parts.join(hit, ["video_id", "clip_name", "part"], "left").withColumn("base_s", F.coalesce("__off", "base_s")).drop("__off")


def localize_words(plans: DataFrame, words: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """Words of each clip in clip time, cut to their part, at least 0.08 s long, repeats at the same time dropped.

    plans (video_id, clip_name, segments); manifest (video_id, clip_name, part, source_start, source_end, offset_s).
    """
    parts = _part_bases(plans, manifest)
    hit = interval_join(
        parts, words.select("video_id", "word_idx", "word", "start_s", "end_s"), ["video_id"], ("p_start", "p_end"), ("start_s", "end_s")
    )
    return _in_clip_time(hit)


def _in_clip_time(hit: DataFrame) -> DataFrame:
    start = F.greatest("start_s", "p_start") - F.col("p_start")
    end = F.greatest(F.least("end_s", "p_end") - F.col("p_start"), start + MIN_WORD_S)
    moved = hit.select(
        "video_id", "clip_name", "part", "word_idx", strip(F.col("word")).alias("word"),
        round_to(F.col("base_s") + start).alias("start_s"), round_to(F.col("base_s") + end).alias("end_s"),
    )
    same = Window.partitionBy("video_id", "clip_name", F.lower("word"), round_to(F.col("start_s"), 2)).orderBy("start_s", "part", "word_idx")
    return moved.withColumn("__n", F.row_number().over(same)).where("__n = 1").drop("__n")


def localize_edited(plans: DataFrame, edited: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """Edited words (video_id, clip_name, word_idx, word, start_s, end_s) in clip time.

    Words count as absolute when the plan says so (``timebase``) or, past 2 s, when the first one lies nearer to
    the clip's start than to zero; relative words stay as they are.
    """
    first = edited.groupBy("video_id", "clip_name").agg(F.min_by("start_s", "word_idx").alias("__w0"))
    begin = F.col("segments")[0]["start_s"]
    near = (begin > 2.0) & (F.abs(F.col("__w0") - begin) < F.abs("__w0"))
    said = F.col("timebase") == "absolute" if "timebase" in plans.columns else F.lit(False)
    kind = plans.join(first, ["video_id", "clip_name"]).select(
        "video_id", "clip_name", F.coalesce(said, F.lit(False)).alias("__said"), F.coalesce(near, F.lit(False)).alias("__near")
    ).select("video_id", "clip_name", (F.col("__said") | F.col("__near")).alias("__abs"))
    marked = edited.join(kind, ["video_id", "clip_name"])
    parts = _part_bases(plans, manifest)
    overlap_ = (F.col("start_s") < F.col("p_end")) & (F.col("end_s") > F.col("p_start"))
    absolute = _in_clip_time(marked.where("__abs").join(parts, ["video_id", "clip_name"]).where(overlap_))
    relative = marked.where("not __abs").select(
        "video_id", "clip_name", F.lit(0).alias("part"), "word_idx", strip(F.col("word")).alias("word"),
        round_to(F.col("start_s")).alias("start_s"), round_to(F.col("end_s")).alias("end_s"),
    )
    return absolute.unionByName(relative)


def chunk_captions(words: DataFrame, case: str = "upper", large: bool | None = None) -> DataFrame:
    """Pair words into two-line captions; long words and long pairs stand alone.

    A word that could open a pair is skipped if the word before it opened one. Words that cannot open a pair are never followed by a
    skipped word, so whether a word opens a caption is a parity: the number of words since the last of those.
    Result: video_id, clip_name, caption_no, line1, line1_start, line2, line2_start, end_s.
    """
    clip, order = ["video_id", "clip_name"], ["start_s", "word_idx", "w", "end_s"]
    block = block_if(large, words, clip, time_block("start_s", 600.0))
    shown = words.select(*clip, "start_s", "word_idx", word_case(strip(F.col("word")), case).alias("w"), "end_s")
    follower = lead(F.struct("w", "start_s", "end_s"))
    near = with_ordered(shown, clip, order, {"__n": follower, "__at": position()}, block)
    second = F.coalesce(F.col("__n.w"), F.lit(""))
    alone = (F.length("w") > LINE_CHARS) | ((second != "") & (F.length("w") + 1 + F.length(second) > PAIR_CHARS))
    pairs = near.withColumn("__alone", alone).withColumn("__pairs", (F.col("w") != "") & ~F.col("__alone") & (second != ""))
    read = with_ordered(pairs, clip, ["__at"], {"__reset": since_reset(~F.col("__pairs"), F.col("__at"))}, None if block is None else row_block("__at"))
    skipped = (F.col("__at") - 1 - F.coalesce("__reset", F.lit(-1))) % 2 == 1
    opens = read.where(~skipped & (F.col("w") != ""))
    has = ~F.col("__alone") & F.col("__n").isNotNull()
    from_ = F.greatest(F.col("__n.start_s"), F.col("start_s") + REVEAL_GAP_S)
    end = F.when(has, F.greatest(F.col("__n.end_s"), from_ + MIN_SECOND_S)).otherwise(F.col("end_s"))
    numbered = with_ordered(opens, clip, ["__at"], {"__no": position()}, None if block is None else row_block("__at"))
    return numbered.select(
        *clip, (F.col("__no") + 1).cast("int").alias("caption_no"), F.col("w").alias("line1"), F.col("start_s").alias("line1_start"),
        F.when(has, F.col("__n.w")).otherwise(F.lit("")).alias("line2"), F.when(has, from_).alias("line2_start"),
        F.greatest(end, F.col("start_s") + MIN_CAPTION_S).alias("end_s"),
    )


def srt_cues(captions: DataFrame) -> DataFrame:
    """One numbered cue text per caption."""
    text = F.trim(F.concat_ws(" ", "line1", "line2"))
    return captions.select(
        "video_id", "clip_name", "caption_no",
        F.concat_ws("\n", F.col("caption_no").cast("string"), F.concat(subtitle_stamp(F.col("line1_start")), F.lit(" --> "), subtitle_stamp(F.col("end_s"))), text, F.lit("")).alias("cue"),
    )


def srt_files(captions: DataFrame) -> DataFrame:
    """The subtitle text of each clip."""
    lines = F.sort_array(F.collect_list(F.struct("caption_no", "cue")))
    return srt_cues(captions).groupBy("video_id", "clip_name").agg(F.array_join(F.transform(lines, lambda x: x["cue"]), "\n").alias("srt"))


def normalize_srt(text: Column) -> Column:
    """Subtitle text in a comparable form: no numbers or blanks, stamps to 10 ms, letters only, lower case."""
    lines = F.transform(F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n"), lambda x: strip(x))
    useful = F.filter(lines, lambda x: (x != "") & ~x.rlike(r"^\p{Nd}+$"))

    def stamp(t):
        base, ms = F.split_part(t, F.lit(","), F.lit(1)), F.split_part(t, F.lit(","), F.lit(2)).try_cast("int")
        fixed = F.concat(base, F.lit(","), F.format_string("%02d", F.rint(ms / 10.0).cast("int")))
        return F.when(t.contains(",") & ms.isNotNull(), fixed).otherwise(t)

    side = lambda x, i: stamp(strip(F.split_part(x, F.lit("-->"), F.lit(i))))
    clean = lambda x: F.when(x.contains("-->"), F.concat(side(x, 1), F.lit(" --> "), side(x, 2))).otherwise(
        F.regexp_replace(strip(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}_\s*]", "")), r"(?U)\s+", " ")
    )
    return F.array_join(F.transform(useful, clean), "\n")


def emphasized(word: Column, symbols: dict[str, str] | None = None) -> Column:
    """The word with the symbol of its keyword behind it, once. The map is a constant of a few entries."""
    table = KEYWORD_SYMBOLS if symbols is None else symbols
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    mark = F.try_element_at(pairs, F.regexp_replace(F.lower(word), r"[^\p{L}\p{N}_]", ""))
    return F.when(mark.isNotNull() & ~word.contains(mark), F.concat(word, F.lit(" "), mark)).otherwise(word)


def emphasize_words(words: DataFrame, symbols: dict[str, str] | None = None) -> DataFrame:
    """Append the symbol of a keyword once."""
    return words.withColumn("word", emphasized(F.col("word"), symbols))


def _matched_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which token of the old text each token of the new one is, if any.

    One text at a time becomes Python's words, as a whole batch of texts would take gigabytes.
    """
    names = ["video_id", "clip_name", "word_idx", "word", "old_no", "n_old"]
    for batch in batches:
        types = [batch.schema.field("video_id").type, batch.schema.field("clip_name").type, pa.int64(), pa.string(), pa.int64(), pa.int64()]
        packed = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
        out = []
        for at in range(batch.num_rows):
            row = batch.slice(at, 1).to_pylist()[0]
            old, new, same = row["old_words"], row["new_tokens"], {}
            for block in SequenceMatcher(None, old, new).get_matching_blocks():
                same.update(zip(range(block.b, block.b + block.size), range(block.a, block.a + block.size), strict=True))
            out += [(row["video_id"], row["clip_name"], j, w, same.get(j, -1), len(old)) for j, w in enumerate(new)]
            if len(out) >= TOKEN_ROWS:
                yield packed(out)
                out = []
        if out:
            yield packed(out)


def align_edits(plans: DataFrame, edits: DataFrame, words: DataFrame) -> DataFrame:
    """Times for the words of edited clip texts.

    edits (video_id, clip_name, transcript_text). Edited tokens that match, or replace as many tokens, keep the old
    times; an uneven replacement splits its span evenly; insertions share the gap between their neighbours.
    """
    changed = edits.join(plans.select("video_id", "clip_name", "segments", F.coalesce("transcript_text", F.lit("")).alias("__old")), ["video_id", "clip_name"])
    changed = changed.where((strip(F.col("transcript_text")) != "") & (strip(F.col("transcript_text")) != strip(F.col("__old"))))
    target = changed.select(
        "video_id", "clip_name", tokens(F.col("transcript_text")).alias("new_tokens"),
        F.col("segments")[0]["start_s"].alias("__a"), F.col("segments")[0]["end_s"].alias("__b"),
    )
    own = interval_join(
        target.select("video_id", "clip_name", "__a", "__b"), words.select("video_id", "word_idx", "word", "start_s", "end_s"),
        ["video_id"], ("__a", "__b"), ("start_s", "end_s"), closed=True,
    ).groupBy("video_id", "clip_name").agg(F.sort_array(F.collect_list(F.struct("word_idx", "word", "start_s", "end_s"))).alias("old"))
    key = ["video_id", "clip_name"]
    rows = target.join(own, key, "left").select(*key, "new_tokens", F.coalesce(F.transform("old", lambda o: o["word"]), F.array().cast("array<string>")).alias("old_words"))
    video = dict(rows.dtypes)["video_id"]
    new = rows.mapInArrow(_matched_tokens, f"video_id {video}, clip_name string, word_idx long, word string, old_no long, n_old long")
    matched = F.col("old_no") >= 0
    linked = with_ordered(
        new, key, ["word_idx"],
        {"__before": last_seen(F.when(matched, F.col("old_no"))), "__after": next_seen(F.when(matched, F.col("old_no"))), "__run": running_sum(F.when(matched, 1).otherwise(0))},
    )
    # a run of unmatched tokens stands where the old tokens between its matched neighbours stood
    run = Window.partitionBy(*key, "__run", "__open")
    placed = linked.withColumn("__open", ~matched).withColumns({
        "__k": F.row_number().over(run.orderBy("word_idx")) - 1, "__n": F.count("*").over(run),
        "__low": F.coalesce("__before", F.lit(-1)), "__high": F.coalesce("__after", "n_old"),
    })
    gone = F.col("__high") - F.col("__low") - 1
    one = F.when(matched, F.col("old_no")).when(gone == F.col("__n"), F.col("__low") + 1 + F.col("__k"))
    placed = placed.withColumns({
        "__one": one.isNotNull(), "__inserted": ~matched & (gone == 0),
        "__a": F.coalesce(one, F.when(gone > 0, F.col("__low") + 1).otherwise(F.col("__low"))),
        "__b": F.coalesce(one, F.when(gone > 0, F.col("__high") - 1).otherwise(F.col("__high"))),
    })
    times = own.select(*key, F.posexplode("old").alias("__no", "__o")).select(*key, F.col("__no").cast("bigint").alias("__no"), "__o.start_s", "__o.end_s")
    side = {c: times.select(*key, F.col("__no").alias(f"__{c}"), F.col("start_s").alias(f"__{c}_start"), F.col("end_s").alias(f"__{c}_end")) for c in "ab"}
    edges = own.select(*key, F.col("old")[0]["start_s"].alias("__first"), F.element_at("old", -1)["end_s"].alias("__last"))
    known = placed.join(side["a"], [*key, "__a"], "left").join(side["b"], [*key, "__b"], "left").join(edges, key, "left")
    low = F.when(F.col("__inserted"), F.coalesce("__a_end", "__first", F.lit(0.0))).otherwise(F.col("__a_start"))
    high = F.when(F.col("__inserted"), F.coalesce("__b_start", "__last", F.lit(10.0))).otherwise(F.col("__b_end"))
    step = (high - low) / (F.col("__n") + F.when(F.col("__inserted"), 1).otherwise(0))
    at = lambda j: round_to(low + (F.col("__k") + j) * step)
    return known.select(
        *key, "word_idx", "word", F.when(F.col("__one"), F.col("__a_start")).otherwise(at(0)).alias("start_s"),
        F.when(F.col("__one"), F.col("__b_end")).otherwise(at(1)).alias("end_s"),
    )


def adjust_ending(plans: DataFrame, new_ends: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Move the end of a plan's last part (video_id, clip_name, new_end).

    The part keeps at least a second and stays inside the source; moves under 0.0005 s change nothing. ``end_status``
    says what happened; edited words of a moved plan no longer hold (``drop_edits``).
    """
    joined = plans.join(new_ends.select("video_id", "clip_name", "new_end"), ["video_id", "clip_name"], "left")
    if sources is not None:
        joined = joined.join(sources.select("video_id", F.col("duration_s").alias("__src")), "video_id", "left")
    else:
        joined = joined.withColumn("__src", F.lit(None).cast("double"))
    last = F.element_at("segments", -1)
    status = (
        F.when(F.col("new_end").isNull(), "kept")
        .when(F.col("new_end") < last["start_s"] + 1.0, "too_early")
        .when((F.col("__src") > 0) & (F.col("new_end") > F.col("__src")), "past_source")
        .when(F.abs(F.col("new_end") - last["end_s"]) >= 0.0005, "moved")
        .otherwise("kept")
    )
    moved = F.transform("segments", lambda p, i: F.when(
        i == F.size("segments") - 1,
        F.struct(p["start_s"].alias("start_s"), round_to(F.col("new_end")).alias("end_s"), round_to(F.col("new_end") - p["start_s"]).alias("duration_s")),
    ).otherwise(F.struct(p["start_s"].alias("start_s"), p["end_s"].alias("end_s"), p["duration_s"].alias("duration_s"))))
    total = F.aggregate("segments", F.lit(0.0), lambda s, p: s + F.greatest(F.lit(0.0), p["end_s"] - p["start_s"]))
    out = joined.withColumn("end_status", status)
    out = out.withColumn("segments", F.when(F.col("end_status") == "moved", moved).otherwise(F.col("segments")))
    return out.withColumns({
        "total_duration": F.when(F.col("end_status") == "moved", round_to(total)).otherwise(F.col("total_duration")),
        "drop_edits": F.col("end_status") == "moved",
    }).drop("new_end", "__src")


def preview_window(end: Column, source: Column, before_s: float = 8.0, after_s: float = 6.0) -> Column:
    """STRUCT<start_s, end_s> of the stretch shown around an end."""
    pre, post = max(2.0, min(30.0, before_s)), max(2.0, min(30.0, after_s))
    stop = end + post
    return F.struct(
        F.greatest(F.lit(0.0), end - pre).alias("start_s"), F.when(source > 0, F.least(source, stop)).otherwise(stop).alias("end_s")
    )
