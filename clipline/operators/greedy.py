"""Keep the best of conflicting rows: a row stays iff no better row that stays conflicts with it.

Rows are split into groups that cannot conflict with each other. A small group is settled in one
expression. A large group is settled in rounds over cells: the best open row of all its cells stays,
and the rows it conflicts with leave. No round builds the pairs of a group: each cell names at most
one winner, so a round joins every open row with one row per cell.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .intervals import buckets, with_islands
from .ordered import block_if, time_block

SMALL_GROUP = 5000

Conflict = Callable[[Column, Column], Column]


def _item(priority: Sequence[str], row_id: Sequence[str], payload: Sequence[str]) -> Column:
    names = list(dict.fromkeys([*priority, *row_id, *payload]))
    return F.struct(*[F.col(c) for c in names])


def _settle_small(groups: DataFrame, keys: list[str], conflict: Conflict, ids: Sequence[str]) -> DataFrame:
    """One ordered pass per group, JVM side, with the rows kept so far as the state."""
    ordered = F.sort_array(F.collect_list("__item"))
    first = F.slice(F.col("__all"), 1, 0)
    kept = F.aggregate(
        "__all",
        first,
        lambda acc, x: F.when(F.exists(acc, lambda k: conflict(k, x)), acc).otherwise(F.concat(acc, F.array(x))),
    )
    return (
        groups.groupBy(*keys)
        .agg(ordered.alias("__all"))
        .select(*keys, F.explode(kept).alias("__k"))
        .select(*keys, *[F.col(f"__k.{c}").alias(c) for c in ids])
    )


def _settle_large(
    groups: DataFrame, keys: list[str], conflict: Conflict, ids: Sequence[str], cells: Column | None
) -> DataFrame:
    """Rounds over cells for groups too large for one row of state."""
    cell_ids = F.array(F.lit(0).cast("bigint")) if cells is None else F.array_distinct(cells)
    undecided = cut_lineage(groups.withColumn("__cells", cell_ids))
    settled = None
    while not undecided.isEmpty():
        spread = undecided.select(*keys, "__item", F.size("__cells").alias("__n"), F.explode("__cells").alias("__cell"))
        tops = spread.groupBy(*keys, "__cell").agg(F.min(F.struct("__item", "__n")).alias("__top"))
        winners = tops.groupBy(*keys, "__top").agg(F.collect_list("__cell").alias("__won"))
        winners = cut_lineage(
            winners.where(F.size("__won") == F.col("__top.__n")).select(
                *keys, F.col("__top.__item").alias("__winner"), "__won"
            )
        )
        settled = winners if settled is None else settled.unionByName(winners)
        by_cell = winners.select(*keys, "__winner", F.explode("__won").alias("__cell"))
        beaten = (
            spread.join(by_cell, [*keys, "__cell"])
            .where((F.col("__item") == F.col("__winner")) | conflict(F.col("__winner"), F.col("__item")))
            .select(*keys, "__item")
            .distinct()
        )
        undecided = cut_lineage(undecided.join(beaten, [*keys, "__item"], "left_anti"))
    if settled is None:
        settled = undecided.select(*keys, F.col("__item").alias("__winner"))
    return settled.select(*keys, *[F.col(f"__winner.{c}").alias(c) for c in ids])


def greedy_select(
    df: DataFrame,
    keys: Sequence[str],
    priority: Sequence[str],
    row_id: Sequence[str],
    payload: Sequence[str],
    conflict: Conflict,
    cells: Column | None = None,
    small_group: int = SMALL_GROUP,
) -> DataFrame:
    """Rows of ``df`` that survive, best first by ascending ``priority``.

    ``conflict(kept, row)`` reads the fields of ``priority``, ``row_id`` and ``payload``. Rows that can conflict
    share ``keys`` and at least one of ``cells`` (an array column; without it the whole group is one cell).
    ``row_id`` makes a row unique within its keys.
    """
    keys = list(keys)
    slim = df.select(*keys, _item([*priority, *row_id], row_id, payload).alias("__item"), *(
        [] if cells is None else [cells.alias("__cell_ids")]
    ))
    sizes = df.groupBy(*keys).agg(F.count("*").alias("__size"))
    large = sizes.where(F.col("__size") > small_group).select(*keys)
    ids = list(row_id)
    cell_col = None if cells is None else F.col("__cell_ids")
    if large.isEmpty():
        kept = _settle_small(slim.drop("__cell_ids"), keys, conflict, ids)
    else:
        large = cut_lineage(large)
        small_side = slim.join(large, keys, "left_anti").drop("__cell_ids")
        kept = _settle_small(small_side, keys, conflict, ids).unionByName(
            _settle_large(slim.join(large, keys, "left_semi"), keys, conflict, ids, cell_col)
        )
    return df.join(kept, [*keys, *ids], "left_semi")


def select_apart(
    df: DataFrame,
    keys: Sequence[str],
    priority: Sequence[str],
    row_id: Sequence[str],
    conflict: Conflict,
    start: str = "start_s",
    end: str = "end_s",
    payload: Sequence[str] = (),
    cell_s: float = 60.0,
    small_group: int = SMALL_GROUP,
    large: bool | None = None,
) -> DataFrame:
    """``greedy_select`` for rows that can conflict only where their spans overlap.

    Runs of overlapping spans are found first: spans of different runs never meet, so each run is a group.
    """
    block = block_if(large, df, keys, time_block(start))
    runs = with_islands(df, keys, [start, end, *row_id], start, end, strict=True, block=block, name="__island")
    kept = greedy_select(
        runs,
        [*keys, "__island"],
        priority,
        row_id,
        list(dict.fromkeys([start, end, *payload])),
        conflict,
        buckets(F.col(start), F.col(end), cell_s),
        small_group,
    )
    return kept.drop("__island")
