"""Joins and groupings over time spans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import last_seen, max_before, next_seen, running_sum, with_ordered

START, END = "start_s", "end_s"


def buckets(start: Column, end: Column, width_s: float) -> Column:
    """Ids of the time buckets a span touches."""
    first = F.floor(start / F.lit(width_s))
    return F.sequence(first, F.greatest(first, F.floor(end / F.lit(width_s))))


def interval_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_iv: tuple[str, str],
    right_iv: tuple[str, str],
    bucket_s: float = 30.0,
    how: str = "inner",
    closed: bool = False,
) -> DataFrame:
    """Pairs whose spans overlap (``l.start < r.end and r.start < l.end``), once each.

    Spans are cut at bucket edges, so the join is an equi-join on (keys, bucket). A pair that shares several
    buckets is kept only in the one where the later of the two starts. Column names other than ``keys`` must differ.
    ``closed`` also keeps spans that only touch.

    Both sides are always sorted and merged: Spark takes the size of a side from the rows before they are cut into buckets (or
    generated), and would send a side of any size to the driver as a broadcast.
    """
    keys = list(keys)
    clash = (set(left.columns) & set(right.columns)) - set(keys)
    if clash:
        raise ValueError(f"rename before joining: {sorted(clash)}")
    ls, le = (F.col(c) for c in left_iv)
    rs, re_ = (F.col(c) for c in right_iv)
    lefts = left.withColumn("__lb", F.floor(ls / bucket_s)).withColumn("__b", F.explode(buckets(ls, le, bucket_s)))
    rights = right.withColumn("__rb", F.floor(rs / bucket_s)).withColumn("__b", F.explode(buckets(rs, re_, bucket_s)))
    meets = ((ls <= re_) & (rs <= le)) if closed else ((ls < re_) & (rs < le))
    pairs = (
        lefts.hint("merge").join(rights, [*keys, "__b"])
        .where(meets & (F.col("__b") == F.greatest("__lb", "__rb")))
        .drop("__b", "__lb", "__rb")
    )
    if how == "inner":
        return pairs
    if how == "left":
        rest = left.join(pairs.select(*left.columns).distinct(), left.columns, "left_anti")
        return pairs.unionByName(rest, allowMissingColumns=True)
    raise ValueError(how)


def with_islands(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    start: str = START,
    end: str = END,
    gap_s: float = 0.0,
    strict: bool = False,
    block: Column | None = None,
    name: str = "island",
) -> DataFrame:
    """Number the runs of spans that follow each other within ``gap_s``; ``strict`` keeps touching spans apart.

    ``order`` begins with the start column and ends with a row id.
    """
    reach = with_ordered(df, keys, order, {"__reach": max_before(F.col(end))}, block)
    apart = (F.col(start) >= F.col("__reach") + gap_s) if strict else (F.col(start) > F.col("__reach") + gap_s)
    flagged = reach.withColumn("__new", F.when(F.col("__reach").isNull() | apart, 1).otherwise(0))
    return with_ordered(flagged, keys, order, {name: running_sum(F.col("__new"))}, block).drop("__reach", "__new")


def islands(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    start: str = START,
    end: str = END,
    gap_s: float = 0.0,
    strict: bool = False,
    block: Column | None = None,
) -> DataFrame:
    """Coalesce spans within ``gap_s`` of the reach so far into one row per run."""
    return (
        with_islands(df, keys, order, start, end, gap_s, strict, block)
        .groupBy(*keys, "island")
        .agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_parts"))
    )


def asof_nearest(
    points: DataFrame,
    targets: DataFrame,
    keys: Sequence[str],
    point: str,
    target: str,
    payload: Sequence[str],
    point_id: Sequence[str],
    within: float | None = None,
    strict_within: bool = False,
    block_s: float | None = None,
    late_wins: bool = False,
) -> DataFrame:
    """For each point, the payload of the target nearest in time; equal distances go to the earlier target.

    One union and one ordered pass instead of a join: each point looks at the last target at or before it and
    the first after it. ``payload`` must order targets that share a time: the first of them is used.
    """
    keys = list(keys)
    side = targets.groupBy(*keys, F.col(target).alias("__t")).agg(
        F.min(F.struct(*[F.col(c) for c in payload])).alias("__hit")
    )
    probe = points.select(*keys, *point_id, F.col(point).alias("__t")).distinct()
    both = probe.withColumn("__kind", F.lit(1)).unionByName(
        side.withColumn("__kind", F.lit(0)), allowMissingColumns=True
    )
    hit = F.when(F.col("__kind") == 0, F.struct(F.col("__t").alias("t"), F.col("__hit").alias("hit")))
    near = with_ordered(
        both,
        keys,
        ["__t", "__kind", *point_id],
        {"__prev": last_seen(hit), "__next": next_seen(hit)},
        None if block_s is None else F.floor(F.col("__t") / block_s),
    ).where(F.col("__kind") == 1)
    before, after = F.col("__t") - F.col("__prev.t"), F.col("__next.t") - F.col("__t")
    closer = (after <= before) if late_wins else (after < before)
    best = F.when(F.col("__prev").isNull() | closer, F.col("__next")).otherwise(F.col("__prev"))
    best = F.coalesce(best, F.col("__prev"))
    near = near.withColumn("__best", best)
    gap = F.abs(F.col("__best.t") - F.col("__t"))
    if within is not None:
        ok = gap < within if strict_within else gap <= within
        near = near.withColumn("__best", F.when(ok, F.col("__best")))
    found = near.select(
        *keys, *point_id, *[F.col(f"__best.hit.{c}").alias(c) for c in payload], F.col("__best.t").alias("__at")
    )
    return points.join(found.withColumnRenamed("__at", f"{target}_near"), [*keys, *point_id], "left")


def nearest_within(
    points: DataFrame,
    targets: DataFrame,
    keys: Sequence[str],
    point: str,
    target: str,
    point_id: Sequence[str],
    within: float,
    name: str,
    strict: bool = True,
) -> DataFrame:
    """For each point the closest target time no further than ``within``; equal distances go to the earlier target.

    A bucketed join: each point meets only the targets of its own stretch of time.
    """
    keys = list(keys)
    probe = points.select(*keys, *point_id, F.col(point).alias("__t")).distinct().withColumns({
        "__lo": F.col("__t") - within, "__hi": F.col("__t") + within,
    })
    spots = targets.select(*keys, F.col(target).alias("__at")).distinct().withColumn("__at2", F.col("__at"))
    gap = F.abs(F.col("__at") - F.col("__t"))
    found = (
        interval_join(probe, spots, keys, ("__lo", "__hi"), ("__at", "__at2"), max(4 * within, 1.0), closed=True)
        .where(gap < within if strict else gap <= within)
        .groupBy(*keys, *point_id)
        .agg(F.min(F.struct(gap.alias("g"), F.col("__at").alias("at")))["at"].alias(name))
    )
    return points.join(found, [*keys, *point_id], "left")


def as_of(
    points: DataFrame,
    turns: DataFrame,
    keys: Sequence[str],
    point: str,
    start: str,
    payload: Sequence[str],
    point_id: Sequence[str],
    block_s: float | None = None,
) -> DataFrame:
    """Attach ``last`` and ``next`` payload structs: the last turn starting at or before the point, the first after it."""
    keys = list(keys)
    side = turns.select(*keys, F.col(start).alias("__t"), F.struct(*[F.col(c) for c in payload]).alias("__hit"))
    probe = points.select(*keys, *point_id, F.col(point).alias("__t"))
    both = probe.withColumn("__kind", F.lit(1)).unionByName(
        side.withColumn("__kind", F.lit(0)), allowMissingColumns=True
    )
    hit = F.when(F.col("__kind") == 0, F.col("__hit"))
    found = with_ordered(
        both,
        keys,
        ["__t", "__kind", "__hit", *point_id],
        {"last_turn": last_seen(hit), "next_turn": next_seen(hit)},
        None if block_s is None else F.floor(F.col("__t") / block_s),
    ).where(F.col("__kind") == 1)
    return points.join(found.select(*keys, *point_id, "last_turn", "next_turn"), [*keys, *point_id])


def with_run_length(
    df: DataFrame, keys: Sequence[str], index: str, flag: Column, name: str, block: Column | None = None
) -> DataFrame:
    """Length of the unbroken run of ``flag`` ending on this row; 0 where the flag is false. ``index`` counts 0, 1, 2 ..."""
    off = F.when(~F.coalesce(flag, F.lit(False)), F.col(index))
    out = with_ordered(df, keys, [index], {"__off": last_seen(off)}, block)
    return out.withColumn(name, F.col(index) - F.coalesce(F.col("__off"), F.lit(-1))).drop("__off")
