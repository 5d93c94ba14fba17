"""End to end: candidates to the final plan."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.align import resolve_candidates
from ..operators.candidates import remove_overlaps, word_exact_text
from ..operators.selection import apply_decisions, apply_merges, plan_shape, select_top, validate_merges, validation_pool
from ..session import cut_lineage_of


def select_clips(
    candidates: DataFrame,
    segments: DataFrame,
    words: DataFrame,
    n: int,
    max_s: float,
    merges: DataFrame | None = None,
    decisions: DataFrame | None = None,
    fallback: DataFrame | None = None,
    allow_overlaps: bool = False,
    large: bool | None = None,
) -> DataFrame:
    """The ``n`` best clips of every video.

    Phrases are resolved to word times, merges applied, plans built, heavy overlaps removed, a pool reviewed and
    the best kept and numbered. Videos without any candidate take those of ``fallback``. The word text is attached
    only to the clips that stay.
    """
    if fallback is not None:
        covered = candidates.select("video_id").distinct()
        candidates = candidates.unionByName(fallback.join(covered, "video_id", "left_anti"), allowMissingColumns=True)
    resolved = resolve_candidates(candidates, words, large=large).drop("resolved")
    if merges is not None:
        resolved = apply_merges(cut_lineage_of(resolved, large), validate_merges(merges), max_s)
    plans = cut_lineage_of(plan_shape(resolved), large)
    if not allow_overlaps:
        plans = remove_overlaps(plans, ["video_id"], ["ord", "candidate_id"], large=large)
    pool = validation_pool(plans, n, tie=("ord", "candidate_id"))
    if decisions is not None:
        pool = apply_decisions(pool, decisions, words, large=large).drop("adjusted")
    final = cut_lineage_of(select_top(pool.drop("clip_index", "clip_name"), n, tie=("ord", "candidate_id")), large)
    return word_exact_text(final, segments, words)
