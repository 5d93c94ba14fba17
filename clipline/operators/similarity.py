"""Near-duplicate texts inside a video, by matching-block similarity, best score kept."""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..session import cut_lineage_in_place
from .ordered import position, with_ordered

THRESHOLD = 0.90


def text_key(text: Column, limit: int | None = 600) -> Column:
    """Lower-case letters, digits and single blanks; ``limit`` characters (None: all)."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(strip(text)), r"[^a-z0-9 ]", ""), r"\s+", " ")
    return F.substring(F.trim(bare), 1, limit) if limit else F.trim(bare)


def clip_text(candidates: DataFrame) -> Column:
    """Stitched text of a candidate: its transcript, else its anchor phrases, else its takeaway or title."""
    phrases = F.array_join(F.flatten(F.transform("segments", lambda p: F.array(
        F.coalesce(p["start_words"], F.lit("")), F.coalesce(p["end_words"], F.lit(""))))), " ")
    pick = lambda c: F.when(strip(c) != "", c)
    return F.coalesce(pick(F.col("clip_transcript")), pick(phrases), pick(F.col("takeaway")), pick(F.col("youtube_title")), F.lit(""))


def _ratio_udf(autojunk: bool):
    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, y, x, autojunk=autojunk).ratio() for x, y in zip(a, b)], dtype="float64")

    return ratio


def _similar(left: DataFrame, right: DataFrame, keys: list[str], threshold: float, autojunk: bool, inside: bool) -> DataFrame:
    """Pairs (keys, hi, lo) of ``left`` over ``right`` whose ratio reaches ``threshold``; ``inside``: the better one of each pair first.

    Two texts meet once they share a letter pair of both prefixes; length and common letters are checked before the ratio.
    """
    side = lambda df, name, size: df.select(*keys, F.col("__me").alias(name), F.length("__key").alias(size), F.explode("__rare").alias("__g"))
    near = F.least("__la", "__lb") >= F.greatest("__la", "__lb") * threshold
    met = side(left, "hi", "__la").join(side(right, "lo", "__lb").hint("merge"), [*keys, "__g"]).where((F.col("hi") < F.col("lo")) & near if inside else near)
    # texts are joined to distinct pairs only; a ratio is never worked out once per common letter pair
    texts = lambda df, name, n: df.select(*keys, F.col("__me").alias(name), F.col("__key").alias(f"__t{n}"), F.col("__counts").alias(f"__c{n}"))
    pairs = met.select(*keys, "hi", "lo").distinct().join(texts(left, "hi", 1).hint("merge"), [*keys, "hi"]).join(texts(right, "lo", 2).hint("merge"), [*keys, "lo"])
    shared = F.aggregate(F.zip_with("__c1", "__c2", lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)
    pairs = pairs.where(2.0 * shared >= threshold * (F.length("__t1") + F.length("__t2")))
    return pairs.where(_ratio_udf(autojunk)(F.col("__t1"), F.col("__t2")) >= threshold).select(*keys, "hi", "lo")


def dedupe_by_similarity(
    candidates: DataFrame, keys: Sequence[str], text: str, score: str, row_id: Sequence[str], threshold: float = THRESHOLD,
    autojunk: bool = False, first_block: int = 64, most_block: int = 512,
) -> DataFrame:
    """Drop a row whose ``text`` is at least ``threshold`` similar to a better kept row of the same key.

    Equal texts collapse first, so a crowd of copies costs one aggregation. The rest is settled from the best down: the
    best open texts of each key make a block (``first_block`` of them, doubled each round up to ``most_block``), the
    block is settled by its own pairs, and only the texts it keeps are held against what is still open. So a text is
    compared with kept texts and with its own block, never with a crowd of texts that leave: a key of n near copies
    costs about n comparisons, not n squared. Texts meet through their rarest letter pairs: a similar pair loses at most
    a share of its letter pairs, so when each text is reduced to its rarest ones past that share, two similar texts
    still have one in common (pairs stand as 32-bit hashes; where two are equal, texts only meet more often). Texts that are empty or NULL are always kept.

    Rows that come spread by ``keys`` stay where they are through all rounds, so their letter pairs are not shuffled.
    """
    keys, ids = list(keys), list(row_id)
    me = F.struct((-F.col(score)).alias("o"), *ids)
    ranked = candidates.select(*keys, *ids, score, F.col(text).alias("__key"))
    best = cut_lineage_in_place(ranked.where("__key <> ''").groupBy(*keys, "__key").agg(F.min(me).alias("__me")))
    size = F.length("__key")
    # unmatched letters on both sides of a pair: at most (1 - t)(a + b), and b is at most a / t
    share = 2 * (1 - threshold) * (1 + 1 / threshold)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), size - 1)), lambda i: F.hash(F.substring(F.col("__key"), i, F.lit(2))))
    spread = best.select(*keys, "__me", size.alias("__len"), F.explode(F.array_distinct(grams)).alias("__g"))
    # the planner takes letter pairs for as few as the texts they come from and would broadcast them
    freq = spread.groupBy(*keys, "__g").agg(F.count("*").alias("__f"))
    ordered = with_ordered(spread.join(freq.hint("merge"), [*keys, "__g"]), [*keys, "__me"], ["__f", "__g"], {"__r": position()})
    rare = ordered.where((F.col("__r") <= F.ceil(F.col("__len") * share)) & (F.col("__f") > 1)).groupBy(*keys, "__me").agg(F.collect_list("__g").alias("__rare"))
    # a text without a shared letter pair is settled at once
    count = lambda ch: F.length("__key") - F.length(F.replace(F.col("__key"), F.lit(ch), F.lit("")))
    counts = F.array(*[count(ch) for ch in "abcdefghijklmnopqrstuvwxyz0123456789 "])
    numbered = lambda open_: open_.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy("__me")))
    still = cut_lineage_in_place(numbered(best.join(rare.hint("merge"), [*keys, "__me"]).withColumn("__counts", counts)))
    kept, block = best.select(*keys, "__me").join(still.select(*keys, "__me"), [*keys, "__me"], "left_anti"), first_block
    while not still.isEmpty():
        top, below = still.where(F.col("__n") <= block), still.where(F.col("__n") > block).drop("__n")
        won = cut_lineage_in_place(keep_unbeaten(top.select(*keys, F.col("__me").alias("me")), _similar(top, top, keys, threshold, autojunk, True), keys))
        won = won.withColumnRenamed("me", "__me")
        lost = _similar(top.join(won, [*keys, "__me"], "left_semi"), below, keys, threshold, autojunk, False)
        still = cut_lineage_in_place(numbered(below.join(lost.select(*keys, F.col("lo").alias("__me")), [*keys, "__me"], "left_anti")))
        kept, block = kept.unionByName(won), min(2 * block, most_block)
    kept_ids = kept.select(*keys, *[F.col(f"__me.{c}").alias(c) for c in ids])
    empty = ranked.where("__key = '' or __key is null").select(*keys, *ids)
    return candidates.join(kept_ids.unionByName(empty), [*keys, *ids], "left_semi")


def keep_unbeaten(items: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Items no kept better item points at. items (keys, me); edges (keys, hi, lo).

    Rounds: an open item without an open better neighbour stays, its worse neighbours leave.
    """
    keys = list(keys)
    edges = cut_lineage_in_place(edges)
    beaten = None
    open_edges = edges
    while not open_edges.isEmpty():
        below = open_edges.select(*keys, F.col("lo").alias("hi")).distinct()
        tops = open_edges.select(*keys, "hi").distinct().join(below, [*keys, "hi"], "left_anti")
        lost = cut_lineage_in_place(open_edges.join(tops, [*keys, "hi"], "left_semi").select(*keys, "lo").distinct())
        beaten = lost if beaten is None else beaten.unionByName(lost)
        gone = lost.withColumnRenamed("lo", "hi")
        open_edges = open_edges.join(lost, [*keys, "lo"], "left_anti").join(gone, [*keys, "hi"], "left_anti")
        open_edges = cut_lineage_in_place(open_edges.join(tops, [*keys, "hi"], "left_anti"))
    return items if beaten is None else items.join(beaten.withColumnRenamed("lo", "me"), [*keys, "me"], "left_anti")
