"""Ordered columns (previous row, running sum, last seen ...) that stay safe when one key is huge.

A plain window partitioned by video puts a whole video into one task. So each key is cut into blocks by a column that
grows with the order (a row number divided by a size, or a time bucket). The window runs inside (key, block); one small
row per block carries the state from block to block, and is joined back. Only where one input row bounds a key by
construction, as one document does its words, a caller may say so and get plain windows. Nothing is counted beforehand.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD_BLOCK = 8192  # rows of a word or segment stream per block
TIME_BLOCK_S = 3600.0  # seconds per block for time-ordered rows

_BLOCK = "__block"


def block_if(large: bool | None, df: DataFrame, keys: Sequence[str], block: Column) -> Column | None:
    """``block``, unless the caller knows that every key is bounded by one input row (``large=False``)."""
    return None if large is False else block


@dataclass(frozen=True)
class Spec:
    kind: str
    value: Column


def lag(value: Column) -> Spec:
    """Value on the previous row."""
    return Spec("lag", value)


def lead(value: Column) -> Spec:
    """Value on the next row."""
    return Spec("lead", value)


def running_sum(value: Column) -> Spec:
    """Sum up to and including this row."""
    return Spec("running_sum", value)


def sum_before(value: Column) -> Spec:
    """Sum over the rows before this one."""
    return Spec("sum_before", value)


def position() -> Spec:
    """0-based position in the order."""
    return Spec("sum_before", F.lit(1).cast("bigint"))


def max_before(value: Column) -> Spec:
    """Largest value on the rows before this one, NULL on the first."""
    return Spec("max_before", value)


def last_seen(value: Column) -> Spec:
    """Last non-NULL value up to and including this row."""
    return Spec("last_seen", value)


def next_seen(value: Column) -> Spec:
    """First non-NULL value from this row on."""
    return Spec("next_seen", value)


def _local(spec: Spec, w: Window, back: Window) -> Column:
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    v = spec.value
    if spec.kind == "lag":
        return F.lag(F.struct(v.alias("v"))).over(w)
    if spec.kind == "lead":
        return F.lead(F.struct(v.alias("v"))).over(w)
    if spec.kind == "running_sum":
        return F.coalesce(F.sum(v).over(upto), F.lit(0))
    if spec.kind == "sum_before":
        return F.coalesce(F.sum(v).over(before), F.lit(0))
    if spec.kind == "max_before":
        return F.max(v).over(before)
    if spec.kind == "last_seen":
        return F.last(v, ignorenulls=True).over(upto)
    if spec.kind == "next_seen":
        # read backwards: a frame that runs to the end of the key would be walked anew for every row
        return F.last(v, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))
    raise ValueError(spec.kind)


def _block_state(spec: Spec, order: Column) -> Column:
    v = spec.value
    if spec.kind == "lag":
        return F.max_by(F.struct(v.alias("v")), order)
    if spec.kind == "lead":
        return F.min_by(F.struct(v.alias("v")), order)
    if spec.kind in ("running_sum", "sum_before"):
        return F.sum(v)
    if spec.kind == "max_before":
        return F.max(v)
    if spec.kind == "last_seen":
        return F.max_by(v, F.when(v.isNotNull(), order))
    return F.min_by(v, F.when(v.isNotNull(), order))


def _carry(spec: Spec, state: Column, w: Window, back: Window) -> Column:
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    if spec.kind == "lag":
        return F.lag(state).over(w)
    if spec.kind == "lead":
        return F.lead(state).over(w)
    if spec.kind in ("running_sum", "sum_before"):
        return F.coalesce(F.sum(state).over(before), F.lit(0))
    if spec.kind == "max_before":
        return F.max(state).over(before)
    if spec.kind == "last_seen":
        return F.last(state, ignorenulls=True).over(before)
    return F.last(state, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))


def _merge(spec: Spec, local: Column, carried: Column) -> Column:
    if spec.kind in ("lag", "lead"):
        return F.coalesce(local, carried)["v"]
    if spec.kind in ("running_sum", "sum_before"):
        return local + carried
    if spec.kind == "max_before":
        return F.greatest(local, carried)
    return F.coalesce(local, carried)


def _both_ways(keys: Sequence[str], order: Sequence[str]) -> tuple[Window, Window]:
    part = Window.partitionBy(*keys)
    return part.orderBy(*order), part.orderBy(*[F.col(c).desc_nulls_last() for c in order])


def with_ordered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    specs: dict[str, Spec],
    block: Column | None = None,
) -> DataFrame:
    """Add one column per spec, reading the rows of each key in ascending ``order``.

    ``order`` must identify a row within its key. ``block`` must never decrease along the order. Leave it out
    only where a key holds few rows: by a count (``block_if``) or by construction (the words of one clip).
    """
    keys = list(keys)
    if block is None:
        w, back = _both_ways(keys, order)
        out = {
            n: (_local(s, w, back)["v"] if s.kind in ("lag", "lead") else _local(s, w, back)) for n, s in specs.items()
        }
        return df.withColumns(out)

    blocked = df.withColumn(_BLOCK, block)
    rank = F.struct(*[F.col(c) for c in order])
    states = blocked.groupBy(*keys, _BLOCK).agg(
        *[_block_state(s, rank).alias(f"__s_{n}") for n, s in specs.items()]
    )
    across, across_back = _both_ways(keys, [_BLOCK])
    carried = states.select(
        *keys, _BLOCK, *[_carry(s, F.col(f"__s_{n}"), across, across_back).alias(f"__c_{n}") for n, s in specs.items()]
    )
    inside, inside_back = _both_ways([*keys, _BLOCK], order)
    return (
        blocked.join(carried, [*keys, _BLOCK])
        .withColumns({f"__l_{n}": _local(s, inside, inside_back) for n, s in specs.items()})
        .withColumns({n: _merge(s, F.col(f"__l_{n}"), F.col(f"__c_{n}")) for n, s in specs.items()})
        .drop(_BLOCK, *[f"__{p}_{n}" for p in "lc" for n in specs])
    )


def with_lag(
    df: DataFrame, keys: Sequence[str], index: str, value: Column, n: int, name: str, block: Column | None = None
) -> DataFrame:
    """Value ``n`` rows back. ``index`` counts the rows of a key without holes, so a large key can join on it."""
    if block is None:
        return df.withColumn(name, F.lag(value, n).over(Window.partitionBy(*keys).orderBy(index)))
    back = df.select(*keys, (F.col(index) + n).alias(index), value.alias(name))
    return df.join(back, [*keys, index], "left")


def time_block(column: str, width_s: float = TIME_BLOCK_S) -> Column:
    return F.floor(F.col(column) / F.lit(width_s))


def row_block(column: str, size: int = WORD_BLOCK) -> Column:
    return F.floor(F.col(column) / F.lit(size))
