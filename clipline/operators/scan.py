"""State that runs along ordered rows, found without folding a key into one row.

Three kinds of state cover the loops of this library. What restarts at certain rows (a parity since the last reset, the start of a run) is
read with the ordered columns of ``ordered``. A decaying mean is an affine function of what came before: blocks of rows compose their
functions, one row per block carries the value on. A chain of jumps, where the next place depends on the last one taken, follows pointers
and doubles their reach in each round. None of them collects a clip, a shot or a run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ordered import Spec, next_seen, position, with_ordered


def follow(starts: DataFrame, links: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every place (keys, at) that is reached from ``starts`` (keys, at) over ``links`` (keys, at, next), once each.

    A link leads strictly onward and a place has one link at most; starts of one chain are not reached from another. Round k joins the
    places reached so far with links of 2^k steps, so a chain of n places takes about log2(n) rounds.
    """
    keys = list(keys)
    reached, hop = cut_lineage(starts.select(*keys, "at")), links.select(*keys, "at", "next")
    while True:
        hop = cut_lineage(hop)
        new = cut_lineage(reached.join(hop, [*keys, "at"]).select(*keys, F.col("next").alias("at")))
        if new.isEmpty():
            return reached
        reached = reached.unionByName(new)
        onward = hop.select(*keys, F.col("at").alias("next"), F.col("next").alias("__next"))
        hop = hop.join(onward, [*keys, "next"]).select(*keys, "at", F.col("__next").alias("next"))


def jumps(points: DataFrame, probes: DataFrame, keys: Sequence[str], block: Column | None = None) -> DataFrame:
    """For each probe (keys, at, k) the first point (keys, k) at or after its ``k``: (keys, at, next). ``block`` reads column ``k``."""
    both = points.select(*keys, "k", F.lit(1).alias("__kind"), F.lit(None).cast(points.schema["k"].dataType).alias("at")).unionByName(
        probes.select(*keys, "k", F.lit(0).alias("__kind"), "at")
    )
    hit = F.when(F.col("__kind") == 1, F.col("k"))
    seen = with_ordered(both, keys, ["k", "__kind", "at"], {"next": next_seen(hit)}, block)
    return seen.where((F.col("__kind") == 0) & F.col("next").isNotNull()).select(*keys, "at", "next")


DECAY_BLOCK = 512  # rows that one fold holds


def decaying_sums(df: DataFrame, keys: Sequence[str], place: str, columns: Sequence[str], ratio: float) -> DataFrame:
    """Replace each of ``columns`` by its value plus ``ratio`` times the sum of the row before. ``place`` counts the rows of a key from 0.

    A block is an affine map: what it is handed, times ratio to the power of its rows, plus its own sum. So the sums at the blocks' ends
    are decaying sums again, of one row per block and the ratio to that power, and are found the same way until nothing is left to hand on.
    """
    keys, rest = list(keys), [c for c in df.columns if c not in {*keys, *columns}]
    item = F.struct(F.col(place), *[F.col(c) for c in rest if c != place], *[F.col(c).cast("double").alias(c) for c in columns])
    blocks = df.groupBy(*keys, F.floor(F.col(place) / DECAY_BLOCK).cast("bigint").alias("__b")).agg(F.sort_array(F.collect_list(item)).alias("__rows"))
    zero = F.struct(*[F.lit(0.0).alias(c) for c in columns])
    after = lambda s, x: F.struct(*[(x[c] + F.lit(ratio) * s[c]).alias(c) for c in columns])
    ends = blocks.select(*keys, F.col("__b"), F.aggregate("__rows", zero, after).alias("__e")).select(*keys, "__b", *[F.col(f"__e.{c}").alias(c) for c in columns])
    left = ratio**DECAY_BLOCK
    if left > 1e-18:
        ends = decaying_sums(ends, keys, "__b", columns, left)
    handed = ends.select(*keys, (F.col("__b") + 1).alias("__b"), F.struct(*columns).alias("__h"))
    blocks = blocks.join(handed, [*keys, "__b"], "left").withColumn("__h", F.coalesce("__h", zero))
    row = lambda x, s: F.struct(*[x[c].alias(c) for c in dict.fromkeys([place, *rest])], *[s[c].alias(c) for c in columns])
    shape = df.select(place, *[c for c in rest if c != place], *[F.col(c).cast("double").alias(c) for c in columns]).schema.simpleString()
    start = F.struct(F.col("__h").alias("s"), F.expr(f"cast(array() as array<{shape}>)").alias("out"))

    def step(a, x):
        s = after(a["s"], x)
        return F.struct(s.alias("s"), F.concat(a["out"], F.array(row(x, s))).alias("out"))

    return blocks.select(*keys, F.inline(F.aggregate("__rows", start, step)["out"])).select(*df.columns)


def decaying_means(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], alpha: float, block: Column | None = None) -> DataFrame:
    """Replace each of ``columns`` by its decaying mean: the first value, then ``alpha * value + (1 - alpha) * mean``."""
    placed = with_ordered(df, keys, order, {"__k": position()}, block)
    shares = placed.withColumns({c: F.when(F.col("__k") == 0, F.col(c)).otherwise(F.lit(alpha) * F.col(c)) for c in columns})
    return decaying_sums(shares, keys, "__k", columns, 1.0 - alpha).drop("__k")


def since_reset(reset: Column, at: Column) -> Spec:
    """Place of the last reset on the rows before this one; what follows from the distance to it (a parity) needs no state."""
    return Spec("max_before", F.when(reset, at))
