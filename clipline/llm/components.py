"""Connected components by alternating large-star and small-star steps, as joins and groupings."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def cut_and_release(df: DataFrame) -> DataFrame:
    """``cut_lineage``, and let go of what led to it: Spark deletes the shuffle files of a plan once the driver has collected its garbage."""
    out = cut_lineage(df)
    del df
    gc.collect()
    out.sparkSession.sparkContext._jvm.System.gc()
    return out


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(least, "a")
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the least node reachable. Ends when a round changes nothing."""
    current = cut_lineage(edges.where(F.col("a") != F.col("b")).distinct())
    size, mark = None, None
    for _ in range(most):
        current = cut_and_release(_small_star(_large_star(current)).where(F.col("a") != F.col("b")).distinct())
        row = current.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
        if (row.n, row.h) == (size, mark):
            break
        size, mark = row.n, row.h
    else:
        raise RuntimeError("components did not settle")
    roots = current.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
