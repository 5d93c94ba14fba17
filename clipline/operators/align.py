"""Quoted phrases to word-exact times, and clean edges for the spans they mark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import round_to
from ..functions.text import INCOMPLETE_ENDS, LEADING_FILLERS, clean_tokens, phrase_side
from ..functions.times import parse_frame
from ..session import cut_lineage_of
from .intervals import interval_join
from .ordered import (
    block_if, lag, last_seen, lead, next_seen, position, row_block, with_lag, with_ordered,
)

MIN_RATIO = 0.7
WIDTHS_S = (15.0, 45.0, 120.0)
DEFAULT_SPAN_S = 30.0
SILENCE_GAP_S = 0.8
MAX_FILLERS = 4
LOOKAHEAD_S = 12.0
LOOKBACK_S = 6.0
SILENCE_BAIL_S = 2.5
PAUSE_S = 0.45
MAX_STEP_BACK = 8
SHARES = 256


def word_shares(freq: DataFrame, shares: int = SHARES) -> DataFrame:
    """Tokens that make up more than one part in ``shares`` of the counted words, and into how many parts to cut each.

    freq (keys..., __f). At most ``shares`` rows come back whatever the input, with ``shares`` parts and one more for each in all.
    """
    total = freq.agg(F.sum("__f")).scalar()
    parts = F.ceil(F.col("__f") * shares / total)
    return freq.where(F.col("__f") * shares > total).select(*[c for c in freq.columns if c != "__f"], parts.alias("__salts"))


def _probes(toks: Column, min_ratio: float) -> Column:
    """Two neighbouring words, or a lone one, from each piece of a phrase: ARRAY<STRUCT<pos, key>>.

    Of n words at least m must match, so of n - m + 1 disjoint pieces one matches whole. Of a longer piece the two neighbours
    with the most letters are taken, as long words are rare.
    """
    n = F.size(toks)
    needed = F.element_at(F.filter(F.sequence(F.lit(1), n), lambda k: k / n >= min_ratio), 1)
    pieces = n - needed + 1
    edge = lambda k: F.floor(k * n / pieces).cast("int")
    letters = lambda i: F.length(F.get(toks, i)) + F.length(F.get(toks, i + 1))

    def probe(k):
        a, z = edge(k), edge(k + 1)
        longest = F.array_max(F.transform(F.sequence(a, z - 2), lambda i: F.struct(letters(i).alias("l"), (-i).alias("o"))))
        return F.when(z - a == 1, F.struct(a.alias("pos"), F.xxhash64(F.get(toks, a)).alias("key"))).otherwise(
            F.struct((-longest["o"]).alias("pos"), F.xxhash64(F.get(toks, -longest["o"]), F.get(toks, 1 - longest["o"])).alias("key"))
        )

    return F.transform(F.sequence(F.lit(0), pieces - 1), probe)


def _places(anchors: DataFrame, words: DataFrame, on: Sequence[str], min_ratio: float, block: Column | None) -> DataFrame:
    """Places where a probe of a phrase stands: video_id, anchor_id, start_idx, __toks, each once."""
    on = list(on)
    phrases = anchors.select(*on, "anchor_id", clean_tokens(F.col("phrase")).alias("__toks")).where(F.size("__toks") > 0)
    probes = phrases.select(*on, "anchor_id", "__toks", F.inline(_probes(F.col("__toks"), min_ratio)))
    near = with_ordered(
        words.select("video_id", "word_idx", "clean"), ["video_id"], ["word_idx"], {"__next": lead(F.struct("word_idx", "clean"))}, block
    )
    one, two = F.xxhash64("clean"), F.xxhash64("clean", F.col("__next.clean"))
    keyed = near.select(
        "video_id", "word_idx", F.explode(F.when(F.col("__next.word_idx") == F.col("word_idx") + 1, F.array(one, two)).otherwise(F.array(one))).alias("key")
    )
    return (
        (keyed.hint("merge") if on else keyed).join(probes, [*on, "key"])
        .select("video_id", "anchor_id", (F.col("word_idx") - F.col("pos")).alias("start_idx"), "__toks")
        .where("start_idx >= 0").distinct()
    )


def _checked(places: DataFrame, words: DataFrame, min_ratio: float, *more: Column) -> DataFrame:
    """Places where all words stand and enough of them match; ``more`` is aggregated over the words of a place (``__k``: 0 is the first)."""
    checks = places.select("video_id", "anchor_id", "start_idx", F.size("__toks").alias("n_tokens"), F.posexplode("__toks").alias("__k", "__want"))
    # merged, as the planner takes words that are made of a text for as small as the text
    hit = checks.withColumn("word_idx", F.col("start_idx") + F.col("__k")).hint("merge").join(words, ["video_id", "word_idx"])
    counted = hit.groupBy("video_id", "anchor_id", "start_idx", "n_tokens").agg(
        F.count("*").alias("__found"), F.count_if(F.col("clean") == F.col("__want")).alias("__hits"), *more
    )
    ratio = F.col("__hits") / F.col("n_tokens")
    whole = counted.where((F.col("__found") == F.col("n_tokens")) & (ratio >= min_ratio))
    return whole.withColumn("ratio", ratio).drop("__found", "__hits")


def phrase_matches(
    anchors: DataFrame, words: DataFrame, on: Sequence[str] = ("video_id",), min_ratio: float = MIN_RATIO, large: bool | None = None
) -> DataFrame:
    """All places where enough words of a phrase stand in their positions.

    anchors (on..., anchor_id, phrase); words (video_id, word_idx, clean). Result: video_id, anchor_id, start_idx,
    n_tokens, ratio. With ``on=[]`` every video is searched.

    Neighbouring words of the phrases (``_probes``) are looked up among the neighbouring words of the videos, then every place
    found is counted in full. Nothing is counted beforehand, and where words are spread by video already they stay there.
    """
    block = block_if(large, words, ["video_id"], row_block("word_idx"))
    return _checked(_places(anchors, words, on, min_ratio, block), words.select("video_id", "word_idx", "clean"), min_ratio)


def timed_matches(
    anchors: DataFrame, words: DataFrame, on: Sequence[str] = ("video_id",), min_ratio: float = MIN_RATIO, large: bool | None = None
) -> DataFrame:
    """``phrase_matches`` with the time of the first and last word and the starts of the words around the first one."""
    block = block_if(large, words, ["video_id"], row_block("word_idx"))
    near = with_ordered(
        words.select("video_id", "word_idx", "clean", "start_s", "end_s"), ["video_id"], ["word_idx"],
        {"s_prev": lag(F.col("start_s")), "s_next": lead(F.col("start_s"))}, block,
    )
    at = lambda k, c, name: F.max(F.when(F.col("__k") == k, F.col(c))).alias(name)
    first = [at(F.lit(0), c, name) for c, name in (("start_s", "match_start"), ("s_prev", "s_prev"), ("s_next", "s_next"))]
    found = _checked(_places(anchors, words, on, min_ratio, block), near, min_ratio, *first, at(F.col("n_tokens") - 1, "end_s", "match_end"))
    return found.withColumn("end_idx", F.col("start_idx") + F.col("n_tokens") - 1)


def in_scope(hint: Column, width: float) -> Column:
    """Whether a match starts between the words nearest to ``hint - width`` and ``hint + width``.

    Nearest is by word start, the earlier word on a tie. A word and its two neighbours are enough to tell.
    """
    lo, hi = hint - width, hint + width
    s, before, after = F.col("match_start"), F.col("s_prev"), F.col("s_next")
    from_lo = (s >= lo) | after.isNull() | ((after >= lo) & (lo - s <= after - lo))
    upto_hi = (s < hi) | before.isNull() | ((before < hi) & (s - hi < hi - before))
    return from_lo & upto_hi


def best_by_scope(matches: DataFrame, keys: Sequence[str], hint: Column) -> DataFrame:
    """Best match per scope, narrow to whole video: highest ratio, then earliest. Columns ``b0`` .. ``b3``.

    Without a hint every scope is the whole video.
    """
    item = F.struct(
        (-F.col("ratio")).alias("o"), F.col("start_idx"), F.col("end_idx"), F.col("match_start"), F.col("match_end"), F.col("ratio")
    )
    scopes = [hint.isNull() | in_scope(hint, w) for w in WIDTHS_S]
    return matches.groupBy(*keys).agg(
        *[F.min(F.when(c, item)).alias(f"b{i}") for i, c in enumerate(scopes)], F.min(item).alias(f"b{len(scopes)}")
    )


def align_phrases(
    anchors: DataFrame, words: DataFrame, on: Sequence[str] = ("video_id",), min_ratio: float = MIN_RATIO,
    large: bool | None = None,
) -> DataFrame:
    """Best place of each phrase per video: the narrowest scope around ``hint_s`` with a match wins."""
    found = timed_matches(anchors, words, on, min_ratio, large)
    hints = anchors.select(*on, "anchor_id", "hint_s")
    keys = ["video_id", "anchor_id"]
    best = best_by_scope(found.join(hints, [*on, "anchor_id"]), keys, F.col("hint_s"))
    pick = F.coalesce(*[F.col(f"b{i}") for i in range(len(WIDTHS_S) + 1)])
    return best.select(*keys, pick.alias("__b")).select(
        *keys, *[F.col(f"__b.{c}") for c in ("start_idx", "end_idx", "match_start", "match_end", "ratio")]
    )


def word_edges(words: DataFrame, large: bool | None = None) -> DataFrame:
    """Per word, where a span that starts or ends on it should start or end instead.

    ``snapped_end``: the end moved off a dangling word, forward to a complete boundary before a silence and within
    the lookahead, else back within the lookback, else back over at most 8 dangling words. ``gap_idx``/``gap_start``:
    the first word at or after this one followed by dead air and the start after it. ``filler_start``: start of the
    first word past a short run of fillers. Computed once for a video, then looked up by word.
    """
    keys, order = ["video_id"], ["word_idx"]
    block = block_if(large, words, keys, row_block("word_idx"))
    # the texts of the words end here: what is sorted and shuffled below is their times and four marks
    base = words.select(
        "video_id", "word_idx", "start_s", "end_s", F.col("clean").isin(*sorted(set(INCOMPLETE_ENDS))).alias("__dangling"),
        F.col("clean").isin(*LEADING_FILLERS).alias("__opener"), F.rtrim("word").rlike(r"[.!?]$").alias("__stop"),
    )
    near = with_ordered(base, keys, order, {"__ns": lead(F.col("start_s"))}, block)
    gap = F.col("__ns") - F.col("end_s")
    near = near.withColumns({
        "__filler": F.col("__opener") & F.col("__ns").isNotNull(),
        "__break": F.col("__stop") | F.coalesce(gap >= PAUSE_S, F.lit(False)),
        "__silent": F.coalesce(gap > SILENCE_BAIL_S, F.lit(False)),
        "__dead": F.coalesce(gap > SILENCE_GAP_S, F.lit(False)),
    }).drop("__opener", "__stop")
    if block is None:
        # one window over the words of a video instead of three joins of all words on (video, place)
        w = Window.partitionBy(*keys).orderBy(*order)
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        near = near.withColumns({
            "__far_end": F.lag("end_s", MAX_STEP_BACK).over(w), "__ahead": F.lead("start_s", MAX_FILLERS).over(w),
            "__zero_end": F.max(F.when(F.col("word_idx") == 0, F.col("end_s"))).over(upto),
        })
    here = F.struct("word_idx", "start_s", "end_s")
    complete = F.when(F.col("__break") & ~F.col("__dangling"), here)
    seen = with_ordered(
        near, keys, order,
        {
            "__next_ok": next_seen(complete),
            "__prev_ok": last_seen(complete),
            "__next_sil": next_seen(F.when(F.col("__silent"), F.col("word_idx"))),
            "__prev_solid": last_seen(F.when(~F.col("__dangling"), here)),
            "__gap": next_seen(F.when(F.col("__dead"), F.struct("word_idx", F.col("__ns").alias("start_s")))),
            "__next_solid": next_seen(F.when(~F.col("__filler"), here)),
        },
        block,
    )
    # a run of more than 4 fillers is rare: only its words look 4 words ahead
    runs_on = F.col("__next_solid.word_idx") > F.col("word_idx") + MAX_FILLERS
    if block is None:
        seen = seen.withColumn("__far_start", F.when(runs_on, F.col("__ahead")))
    else:
        seen = with_lag(seen, keys, "word_idx", F.col("end_s"), MAX_STEP_BACK, "__far_end", block)
        ahead = base.select("video_id", (F.col("word_idx") - MAX_FILLERS).alias("word_idx"), F.col("start_s").alias("__far_start"))
        long_run = seen.where(runs_on).select("video_id", "word_idx")
        seen = seen.join(ahead.join(long_run, [*keys, *order], "left_semi"), [*keys, *order], "left")
        seen = seen.join(base.where("word_idx = 0").select("video_id", F.col("end_s").alias("__zero_end")), "video_id", "left")
    first_end = F.coalesce("__far_end", F.col("__zero_end"))
    end = F.col("end_s")
    forward_ok = (
        F.col("__next_ok").isNotNull()
        & (F.col("__next_sil").isNull() | (F.col("__next_ok.word_idx") <= F.col("__next_sil")))
        & (F.col("__next_ok.start_s") <= end + LOOKAHEAD_S)
    )
    back_ok = F.col("__prev_ok").isNotNull() & (F.col("__prev_ok.end_s") >= end - LOOKBACK_S)
    solid_near = F.col("__prev_solid.word_idx") >= F.col("word_idx") - MAX_STEP_BACK
    snapped = (
        F.when(~F.col("__dangling"), end)
        .when(forward_ok, F.col("__next_ok.end_s"))
        .when(back_ok, F.col("__prev_ok.end_s"))
        .when(solid_near, F.col("__prev_solid.end_s"))
        .otherwise(first_end)
    )
    return seen.select(
        "video_id", "word_idx", "start_s", "end_s", snapped.alias("snapped_end"),
        F.col("__gap.word_idx").alias("gap_idx"), F.col("__gap.start_s").alias("gap_start"),
        F.coalesce("__far_start", F.col("__next_solid.start_s"), F.col("start_s")).alias("filler_start"),
    )


def resolve_boundaries(
    parts: DataFrame, words: DataFrame, on: Sequence[str] = ("video_id",), large: bool | None = None
) -> DataFrame:
    """Word-exact spans of candidate parts.

    parts: on..., candidate_id, part, start_words, end_words, start_hint, end_hint, and optionally numeric
    ``range_start``/``range_end`` that pass through. Result: video_id, candidate_id, part, start_s, end_s of parts
    that resolve. The start may sit in any scope around its hint; the end must lie after it.
    """
    on = list(on)
    key = [*on, "candidate_id", "part"]
    ranged = "range_start" in parts.columns
    is_range = F.col("range_start").isNotNull() & F.col("range_end").isNotNull() if ranged else F.lit(False)
    phrased = parts.where(~is_range)
    end_text = F.when(F.trim(F.coalesce("end_words", F.lit(""))) != "", F.col("end_words")).otherwise(F.col("start_words"))
    sides = phrased.select(
        *key, "start_hint", "end_hint",
        F.inline(F.array(
            F.struct(F.lit("s").alias("side"), phrase_side(F.col("start_words"), "start").alias("phrase")),
            F.struct(F.lit("e").alias("side"), phrase_side(end_text, "end").alias("phrase")),
        )),
    ).withColumn("anchor_id", F.struct("candidate_id", "part", "side"))
    used = words if not on else words.join(parts.select(*on).distinct(), on, "left_semi")
    # read twice, by the starts and by the ends
    found = cut_lineage_of(timed_matches(sides.select(*on, "anchor_id", "phrase"), used, on, large=large), large)
    found = found.withColumns({c: F.col(f"anchor_id.{c}") for c in ("candidate_id", "part", "side")})
    hints = phrased.select(*key, "start_hint", "end_hint")
    k = ["video_id", "candidate_id", "part"]
    first = lambda: F.coalesce(*[F.col(f"b{i}") for i in range(4)])
    starts = best_by_scope(found.where("side = 's'").join(hints, key), k, F.col("start_hint")).select(
        *k, first().alias("__s")
    )
    hint = F.when(F.coalesce(F.col("end_hint"), F.lit(0.0)) != 0, F.col("end_hint")).otherwise(
        F.col("__s.match_start") + DEFAULT_SPAN_S
    )
    ends = best_by_scope(
        found.where("side = 'e'").join(hints, key).join(starts.withColumn("__s0", F.col("__s.match_start")), k)
        .withColumn("__hint", hint),
        [*k, "__s"], F.col("__hint"),
    )
    after = lambda c: F.col(f"{c}.match_end") > F.col("__s.match_start")
    chosen = F.coalesce(
        *[F.when(after(f"b{i}"), F.col(f"b{i}")) for i in range(3)],
        F.when(F.col("b2").isNull() & after("b3"), F.col("b3")),
    )
    both = ends.withColumn("__e", chosen).where(F.col("__e").isNotNull())
    # both edges of a span in one pass over the words
    wanted = both.withColumn("word_idx", F.explode(F.array_distinct(F.array(F.col("__s.start_idx"), F.col("__e.end_idx")))))
    edges = word_edges(used, large).select("video_id", "word_idx", "gap_idx", "gap_start", "filler_start", "snapped_end")
    at = lambda place, c: F.max(F.when(F.col("word_idx") == place, F.col(c))).alias(c)
    both = wanted.hint("merge").join(edges, ["video_id", "word_idx"]).groupBy(*k, "__s", "__e").agg(
        *[at(F.col("__s.start_idx"), c) for c in ("gap_idx", "gap_start", "filler_start")], at(F.col("__e.end_idx"), "snapped_end")
    ).withColumn("__si", F.col("__s.start_idx"))
    begin = F.col("__s.match_start")
    quiet = F.when((F.col("__s.end_idx") > F.col("__si")) & (F.col("gap_idx") < F.col("__s.end_idx")), F.col("gap_start")).otherwise(begin)
    trimmed = F.greatest(quiet, F.col("filler_start"))
    start = F.when(trimmed >= F.col("__e.match_end"), quiet).otherwise(trimmed)
    both = both.withColumn("__start", start)
    end = F.when(F.col("snapped_end") <= F.col("__start"), F.col("__e.match_end")).otherwise(F.col("snapped_end"))
    out = both.select(*k, round_to(F.col("__start")).alias("start_s"), round_to(end).alias("end_s"))
    if ranged:
        through = parts.where(is_range & (F.col("range_end") > F.col("range_start"))).select(
            *k, round_to(F.col("range_start")).alias("start_s"), round_to(F.col("range_end")).alias("end_s")
        )
        out = out.unionByName(through)
    return out


def resolve_candidates(
    candidates: DataFrame, words: DataFrame, on: Sequence[str] = ("video_id",), large: bool | None = None
) -> DataFrame:
    """Replace the ``segments`` of each candidate whose parts all resolve; the others stay as they are.

    ``segments`` is ARRAY<STRUCT<start_s, end_s, start_words, start_frame, end_words, end_frame>>. Adds ``resolved``.
    """
    exploded = candidates.select("video_id", "candidate_id", F.posexplode("segments").alias("part", "__p"))
    text = lambda c: F.trim(F.coalesce(F.col(f"__p.{c}"), F.lit("")))
    sf, ef = parse_frame(F.col("__p.start_frame")), parse_frame(F.col("__p.end_frame"))
    anchored = (text("start_words") != "") | (text("end_words") != "")
    framed = (text("start_frame") != "") | (text("end_frame") != "")
    parts = exploded.where(anchored | ~framed).select(
        "video_id", "candidate_id", "part",
        text("start_words").alias("start_words"), text("end_words").alias("end_words"),
        sf["a"].alias("start_hint"), F.coalesce(ef["b"], sf["b"]).alias("end_hint"),
        F.when(~anchored & ~framed, F.col("__p.start_s")).alias("range_start"),
        F.when(~anchored & ~framed, F.col("__p.end_s")).alias("range_end"),
    ).where(anchored_or_range())
    spans = resolve_boundaries(parts, words, on, large)
    wanted = parts.groupBy("video_id", "candidate_id").agg(F.count("*").alias("__want"))
    got = spans.groupBy("video_id", "candidate_id").agg(
        F.count("*").alias("__got"), F.sort_array(F.collect_list(F.struct("part", "start_s", "end_s"))).alias("__spans")
    )
    done = wanted.join(got, ["video_id", "candidate_id"]).where("__want = __got").select("video_id", "candidate_id", "__spans")
    shape = lambda x: F.struct(
        x["start_s"].alias("start_s"), x["end_s"].alias("end_s"),
        *[F.lit(None).cast("string").alias(c) for c in ("start_words", "start_frame", "end_words", "end_frame")],
    )
    joined = candidates.join(done, ["video_id", "candidate_id"], "left")
    return joined.withColumns({
        "resolved": F.col("__spans").isNotNull(),
        "segments": F.when(F.col("__spans").isNotNull(), F.transform("__spans", shape)).otherwise(F.col("segments")),
    }).drop("__spans")


def anchored_or_range() -> Column:
    return (F.col("start_words") != "") | (F.col("end_words") != "") | (F.col("range_end") > F.col("range_start"))


def snap_end(ends: DataFrame, words: DataFrame, large: bool | None = None) -> DataFrame:
    """Snapped end time for given end words (video_id, word_idx)."""
    return ends.join(word_edges(words, large).select("video_id", "word_idx", "snapped_end"), ["video_id", "word_idx"])


def forward_trim_weak_start(
    plans: DataFrame, words: DataFrame, weak: Sequence[str], min_s: float, large: bool | None = None
) -> DataFrame:
    """Move the start of a plan forward over weak openers while it keeps 80 % of ``min_s``.

    plans (video_id, clip_id, start_s, end_s, total_s). The first word at or after the start (0.05 s slack) opens
    the walk; the run of weak words it stands in gives where the walk must stop.
    """
    block = block_if(large, words, ["video_id"], row_block("word_idx"))
    opener = F.lower(F.regexp_replace("word", r"^[^A-Za-z0-9]+", ""))
    linked = with_ordered(
        words.select("video_id", "word_idx", "word", "start_s").withColumn("__weak", opener.isin(*weak)),
        ["video_id"], ["word_idx"], {"__ns": lead(F.col("start_s")), "__ps": lag(F.col("start_s"))}, block,
    )
    runs = with_ordered(
        linked, ["video_id"], ["word_idx"],
        {"__stop": next_seen(F.when(~F.col("__weak") | F.col("__ns").isNull(), F.col("word_idx")))}, block,
    )
    # a word is the first at or after a start when the start lies in (previous word, this word] with the slack
    spots = runs.select(
        "video_id", F.col("word_idx").alias("__i"), "__stop",
        F.coalesce(F.col("__ps") + 0.05, F.lit(0.0)).alias("__lo"), (F.col("start_s") + 0.05).alias("__hi"),
    )
    probe = plans.select("video_id", "clip_id", "start_s", "total_s", F.col("start_s").alias("__p"), F.col("start_s").alias("__p2"))
    at = (
        interval_join(probe, spots, ["video_id"], ("__p", "__p2"), ("__lo", "__hi"), closed=True)
        .groupBy("video_id", "clip_id", "start_s", "total_s").agg(F.min(F.struct("__i", "__stop")).alias("__w"))
    )
    steps = at.where(F.col("__w.__stop") > F.col("__w.__i")).select(
        "video_id", "clip_id", F.col("start_s").alias("__p"), "total_s", F.col("__w.__i").alias("__i"),
        F.explode(F.sequence(F.col("__w.__i") + 1, F.col("__w.__stop"))).alias("word_idx"),
    )
    reached = steps.join(linked.select("video_id", "word_idx", "start_s", "__ps"), ["video_id", "word_idx"])
    # each step is measured from where the walk stands; the first one that cuts too much ends it
    stand = F.when(F.col("word_idx") == F.col("__i") + 1, F.col("__p")).otherwise(F.col("__ps"))
    short = F.col("total_s") - (F.col("start_s") - stand) < 0.8 * min_s
    walk = reached.groupBy("video_id", "clip_id").agg(
        F.min(F.when(short, F.col("word_idx"))).alias("__bad"),
        F.sort_array(F.collect_list(F.struct("word_idx", "start_s"))).alias("__at"),
    )
    taken = F.filter("__at", lambda x: F.col("__bad").isNull() | (x["word_idx"] < F.col("__bad")))
    moved = walk.select("video_id", "clip_id", F.try_element_at(F.transform(taken, lambda x: x["start_s"]), F.lit(-1)).alias("__new"))
    return plans.join(moved, ["video_id", "clip_id"], "left").withColumn(
        "start_s", round_to(F.coalesce("__new", F.col("start_s")))
    ).drop("__new")


def clause_end_before(ranges: DataFrame, words: DataFrame) -> DataFrame:
    """Last clause punctuation inside (start_s, end_s]; ``clause_end`` is the end itself without one.

    ranges (video_id, clip_id, start_s, end_s).
    """
    stops = words.where(F.rtrim("word").rlike(r"[.,;:—–-]$")).select(
        "video_id", F.col("end_s").alias("__at"), F.col("end_s").alias("__at2")
    )
    hit = (
        interval_join(ranges, stops, ["video_id"], ("start_s", "end_s"), ("__at", "__at2"), closed=True)
        .where((F.col("__at") > F.col("start_s")) & (F.col("__at") <= F.col("end_s")))
        .groupBy("video_id", "clip_id").agg(F.max("__at").alias("__last"))
    )
    return ranges.join(hit, ["video_id", "clip_id"], "left").withColumn(
        "clause_end", F.coalesce("__last", F.col("end_s"))
    ).drop("__last")
