"""Copy texts, tags, packages, and the files behind each clip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import FILLER_TAGS, blank_to_null, clean_hashtags, ordered_distinct, strip, tokens

# Tag sizes, tag pools and stop words.
MIN_TAGS, MAX_TAGS = 12, 15
TOPIC_TAGS = 9
STOPWORDS = (
    "this", "that", "with", "from", "your", "about", "there", "their",
    "would", "could", "should", "because", "really", "people", "thing",
    "things", "video", "clip", "just", "like", "what", "when", "where",
)
TOPIC_POOL = ("#insight", "#learning", "#shorts", "#reels", "#fyp", "#viralclips", "#creator", "#storytelling")
COPY_POOL = (
    "#insight", "#learning", "#shorts", "#reels", "#fyp",
    "#creator", "#mindset", "#storytelling", "#viralclips", "#content",
)
GENERIC_TAGS = (
    "#viral", "#trending", "#mustwatch", "#clips", "#reels", "#shorts",
    "#fyp", "#foryou", "#foryoupage", "#explore", "#explorepage",
)
DRAFT_TAGS = ("#hashtag", "#tag", "#draft", "#temp")
OUTPUT_MARKS = ("_branded", "_proxy", "_raw", "_filter", "_drytest")


def _texts(*items: str) -> Column:
    return F.array(*[F.lit(i) for i in items])


def _no_texts() -> Column:
    return F.expr("cast(array() as array<string>)")


def topic_tags(title: Column, reason: Column, text: Column, min_tags: int = MIN_TAGS, max_tags: int = MAX_TAGS) -> Column:
    """Tags from the words of a clip: nine topic words, then the pool, padded before the last one."""
    said = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(reason, F.lit("")), F.coalesce(text, F.lit("")))
    words = F.regexp_extract_all(said, F.lit(r"[A-Za-z][A-Za-z0-9]{3,}"), F.lit(0))
    topical = F.filter(F.transform(words, lambda w: F.lower(w)), lambda w: ~w.isin(*STOPWORDS))
    own = F.slice(F.array_distinct(F.transform(topical, lambda w: F.concat(F.lit("#"), F.substring(w, 1, 24)))), 1, TOPIC_TAGS)
    tags = F.array_distinct(F.concat(own, _texts(*TOPIC_POOL)))
    short = F.greatest(F.lit(0), F.lit(max(10, min_tags)) - F.size(tags))
    padded = F.concat(F.slice(tags, F.lit(1), F.size(tags) - 1), F.array_repeat(F.lit("#content"), short), F.slice(tags, -1, 1))
    return F.slice(padded, 1, max_tags)


def fallback_copy(plans: DataFrame) -> DataFrame:
    """Adds ``fallback`` STRUCT<title, description, caption, hashtags> drawn from the plan itself."""
    col = lambda c: strip(F.coalesce(F.col(c), F.lit(""))) if c in plans.columns else F.lit("")
    tags = F.coalesce(F.col("hashtags"), _no_texts()) if "hashtags" in plans.columns else _no_texts()
    ready = (col("caption") != "") & (col("description") != "") & (F.size(tags) >= 10)
    title = F.coalesce(blank_to_null(col("title")), F.lit("Key Moment"))
    source = F.coalesce(blank_to_null(col("reason")), blank_to_null(col("transcript_text")))
    short = F.substring(title, 1, 70)
    from_plan = F.struct(
        F.substring(title, 1, 90).alias("title"), col("description").alias("description"), F.substring(col("caption"), 1, 180).alias("caption"), F.slice(tags, 1, MAX_TAGS).alias("hashtags"),
    )
    from_text = F.struct(
        short.alias("title"),
        F.coalesce(F.substring(source, 1, 360), F.concat(F.lit("This clip highlights a specific, standalone moment from "), short, F.lit("."))).alias("description"),
        short.alias("caption"), topic_tags(short, col("reason"), col("transcript_text")).alias("hashtags"),
    )
    return plans.withColumn("fallback", F.when(ready, from_plan).otherwise(from_text))


def normalize_copy(plans: DataFrame, copy: DataFrame, min_tags: int = MIN_TAGS, max_tags: int = MAX_TAGS) -> DataFrame:
    """Copy per clip with fallbacks, caps and padded tags; copy that says nothing specific gives way to the fallback.

    copy (video_id, clip_name, title, description, caption, hashtags ARRAY<STRING>).
    """
    c = copy.select("video_id", "clip_name", *[F.col(x).alias(f"__{x}") for x in ("title", "description", "caption", "hashtags")])
    joined = fallback_copy(plans).join(c, ["video_id", "clip_name"], "left")
    fb = lambda x: F.col(f"fallback.{x}")
    pick = lambda x: strip(F.coalesce(blank_to_null(F.col(f"__{x}")), fb(x)))
    given = F.when(F.size(F.coalesce("__hashtags", _no_texts())) > 0, F.col("__hashtags")).otherwise(fb("hashtags"))
    cleaned = F.filter(clean_hashtags(given), lambda t: t != "")
    has = F.exists(cleaned, lambda t: F.lower(t) == "#fyp")
    top = max(12, max_tags)
    low = max(10, min(top, min_tags))
    joined = joined.withColumn("__tags", F.slice(F.when(has, cleaned).otherwise(F.concat(cleaned, _texts("#fyp"))), 1, top))
    spare = F.filter(F.array_distinct(F.concat(fb("hashtags"), _texts(*COPY_POOL))), lambda t: ~F.array_contains(F.col("__tags"), t))
    joined = joined.withColumn("__tags", F.concat("__tags", F.slice(spare, F.lit(1), F.greatest(F.lit(0), low - F.size("__tags")))))
    caption = F.substring(pick("caption"), 1, 180)
    specific = F.size(F.array_except(F.transform("__tags", lambda t: F.lower(t)), _texts(*GENERIC_TAGS)))
    generic = (caption == "") | (F.lower(caption) == F.lower(strip(F.coalesce("title", F.lit(""))))) | (specific < 4)
    own = F.struct(F.substring(pick("title"), 1, 90).alias("title"), pick("description").alias("description"), caption.alias("caption"), F.slice("__tags", 1, top).alias("hashtags"))
    out = joined.withColumn("__out", F.when(generic, F.col("fallback")).otherwise(own)).withColumn("generic", generic)
    return out.select("video_id", "clip_name", F.col("__out.title").alias("social_title"), F.col("__out.description").alias("social_description"), F.col("__out.caption").alias("social_caption"), F.col("__out.hashtags").alias("hashtags"), "generic")


def strip_filler(tags: Column) -> Column:
    """Tags without the generic filler ones."""
    filler = F.split(F.lit(FILLER_TAGS), " ")
    return F.filter(tags, lambda t: (t != "") & ~F.array_contains(filler, F.lower(t)))


def merge_tags(tags: Column) -> Column:
    """Topic tags first, then the filler block, each tag once whatever its case."""
    hashed = lambda t: F.when(t.startswith("#"), t).otherwise(F.concat(F.lit("#"), t))
    all_tags = F.concat(F.filter(F.transform(tags, strip), lambda t: t != ""), F.split(F.lit(FILLER_TAGS), " "))
    return ordered_distinct(F.transform(all_tags, hashed), F.lower)


def lower_tags(tags: Column) -> Column:
    """Lower-case tags behind exactly one ``#``, each once."""
    one = lambda t: F.concat(F.lit("#"), F.lower(F.ltrim(F.regexp_replace(strip(t), r"^#+", ""))))
    return F.array_distinct(F.filter(F.transform(tags, one), lambda t: t != "#"))


def metadata_coverage(plans: DataFrame) -> DataFrame:
    """Whether at least half of a video's clips carry a description and tags."""
    full = blank_to_null(F.col("description")).isNotNull() & (F.size(F.coalesce("hashtags", _no_texts())) > 0)
    return plans.groupBy("video_id").agg(F.count_if(full).alias("n_full"), F.count("*").alias("n_clips")).withColumn(
        "covered", F.col("n_full") >= F.greatest(F.lit(1), F.floor(F.col("n_clips") / 2))
    )


def package_text(plans: DataFrame) -> DataFrame:
    """Ready-to-paste sections per clip: title, description with tags, tags, spoken hook."""
    col = lambda c: strip(F.coalesce(F.col(c), F.lit(""))) if c in plans.columns else F.lit("")
    tags = F.array_join(lower_tags(F.coalesce("hashtags", _no_texts())), " ")
    text = F.concat_ws(
        "\n", F.lit("=== TITLE ==="), col("title"), F.lit(""), F.lit("=== DESCRIPTION ==="), col("description"),
        F.when(tags != "", F.concat(F.lit("\n"), tags)), F.lit(""), F.lit("=== TAGS (comma-separated) ==="), col("youtube_tags"),
        F.when(col("hook_phrase") != "", F.concat(F.lit("\n=== TTS HOOK ===\n"), col("hook_phrase"))),
    )
    return plans.where(F.coalesce("clip_name", F.lit("")) != "").select(
        "video_id", "clip_name", F.concat(F.regexp_replace(text, r"\s+$", ""), F.lit("\n")).alias("package")
    )


def package_results(
    plans: DataFrame, old: DataFrame, copy: DataFrame, files: DataFrame, words: DataFrame | None = None, prefer_old: bool = False
) -> DataFrame:
    """Final record per clip: each field from the plan, else the earlier result, else the copy; file flags; words.

    ``prefer_old`` takes earlier results and copy first, as after a skipped copy stage. Tags that look like drafts or
    are fewer than five give way. files (video_id, clip_name, kind).
    """
    fields = ("title", "reason", "social_title", "social_description", "social_caption", "hook_title")
    from_copy = {"title": "title", "social_title": "title", "social_description": "description", "social_caption": "caption"}
    o = old.select("video_id", "clip_name", *[F.col(f).alias(f"__o_{f}") for f in (*fields, "hashtags") if f in old.columns])
    c = copy.select("video_id", "clip_name", *[F.col(f).alias(f"__c_{f}") for f in ("title", "description", "caption", "hashtags") if f in copy.columns])
    joined = plans.join(o, ["video_id", "clip_name"], "left").join(c, ["video_id", "clip_name"], "left")
    have = set(joined.columns)
    col = lambda n: F.nullif(F.col(n), F.lit("")) if n in have else F.lit(None).cast("string")

    def text(f):
        mine, before, said = col(f), col(f"__o_{f}"), col(f"__c_{from_copy.get(f, '')}")
        return F.coalesce(*((before, said, mine) if prefer_old else (mine, before, said)), F.lit("")).alias(f)

    arr = lambda n: F.when(F.size(F.col(n)) > 0, F.col(n)) if n in have else F.lit(None).cast("array<string>")
    mine, before, said = arr("hashtags"), arr("__o_hashtags"), arr("__c_hashtags")
    draft = F.exists(mine, lambda t: F.lower(t).isin(*DRAFT_TAGS)) | (F.size(mine) < 5)
    tags = F.coalesce(*((before, said, mine) if prefer_old else (F.when(~draft, mine), before, said, mine)), _no_texts())
    kinds = files.groupBy("video_id", "clip_name").agg(F.collect_set("kind").alias("__kinds"))
    joined = joined.join(kinds, ["video_id", "clip_name"], "left").withColumn("__kinds", F.coalesce("__kinds", _no_texts()))
    flag = lambda k: F.array_contains("__kinds", k)
    score = [F.col(s) for s in ("hook_score", "flow_score", "virality_score") if s in have]
    out = joined.select(
        "video_id", "clip_name", F.col("total_duration").alias("duration"), *score, *[text(f) for f in fields], tags.alias("hashtags"),
        *[flag(k).alias(f"has_{k}") for k in ("raw", "hooked", "captioned", "srt", "ass", "caption_txt")],
        (~flag("raw") | ~flag("captioned")).alias("caption_failed"),
    )
    if words is None:
        return out
    own = words.groupBy("video_id", "clip_name").agg(F.sort_array(F.collect_list(F.struct("start_s", "end_s", "word"))).alias("words"))
    return out.join(own, ["video_id", "clip_name"], "left")


def discover_targets(plans: DataFrame, files: DataFrame) -> DataFrame:
    """Clips to work on: planned clips with a file, then files without a plan, else any media file of the job.

    files (video_id, clip_name, path, folder, captioned BOOLEAN). Own outputs are never taken in again.
    """
    first = files.where("captioned").groupBy("video_id", "clip_name").agg(F.max("path").alias("path"))
    planned = first.join(plans.select("video_id", "clip_name").distinct(), ["video_id", "clip_name"], "left_semi").withColumn("source", F.lit("plan"))
    loose = first.join(plans.select("video_id", "clip_name"), ["video_id", "clip_name"], "left_anti").withColumn("source", F.lit("file"))
    known = planned.unionByName(loose)
    stem = F.regexp_extract("path", r"([^/]*)$", 1)
    marked = F.exists(_texts(*OUTPUT_MARKS), lambda m: stem.contains(m))
    branded = F.array_contains(F.split(F.coalesce("folder", F.lit("")), "/"), "branded")
    other = files.where(~marked & ~branded).join(known.select("video_id").distinct(), "video_id", "left_anti")
    nested = F.when(F.coalesce("folder", F.lit("")) != "", F.concat(F.replace("folder", F.lit("/"), F.lit("__")), F.lit("__"), F.col("clip_name"))).otherwise(F.col("clip_name"))
    external = other.groupBy("video_id", nested.alias("clip_name")).agg(F.min("path").alias("path")).withColumn("source", F.lit("external"))
    return known.unionByName(external)


def style_suffix(style: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(style), r"[^A-Za-z0-9]+", "_"), r"^_+|_+$", "")


def pick_variant(files: DataFrame, style: Column | None = None) -> DataFrame:
    """The caption file of each clip: the wanted style with hook, the style, any hooked, the newest; and all variants.

    files (video_id, clip_name, file, suffix, modified).
    """
    want = style_suffix(style) if style is not None else F.lit("")
    suffix = F.coalesce("suffix", F.lit(""))
    rank = (
        F.when((want != "") & (suffix == F.concat(want, F.lit("_hooked"))), 0)
        .when((want != "") & (suffix == want), 1)
        .when(suffix.endswith("_hooked"), 2)
        .otherwise(3)
    )
    age = F.when(rank < 3, F.lit(0.0)).otherwise(-F.col("modified").cast("double"))
    label = F.when(suffix != "", F.initcap(F.replace(suffix, F.lit("_"), F.lit(" ")))).otherwise(F.lit("Default"))
    return files.groupBy("video_id", "clip_name").agg(
        F.min_by("file", F.struct(rank, age, F.col("file"))).alias("primary_file"),
        F.sort_array(F.collect_list(F.struct("file", label.alias("label"), suffix.alias("suffix")))).alias("variants"),
    )
