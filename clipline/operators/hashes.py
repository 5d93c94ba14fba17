"""Nearest neighbours among 64-bit hashes, by multi-index hashing with a growing radius."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import hamming_bits
from ..session import cut_lineage

BANDS = 4
BAND_BITS = 64 // BANDS
BLOCK = 1024


def band_keys(phash: Column, flips: int = 0) -> Column:
    """The hash cut into bands of 16 bits, each with up to ``flips`` bits turned, as numbers that name the band too."""
    masks = F.lit([sum(1 << b for b in bits) for n in range(flips + 1) for bits in combinations(range(BAND_BITS), n)]).cast("array<bigint>")

    def turned(k: int) -> Column:
        part = F.shiftrightunsigned(phash, k * BAND_BITS).bitwiseAND(F.lit((1 << BAND_BITS) - 1).cast("bigint"))
        return F.transform(masks, lambda m: part.bitwiseXOR(m) * F.lit(BANDS) + F.lit(k))

    return F.concat(*[turned(k) for k in range(BANDS)])


def in_blocks(items: DataFrame, keys: Sequence[str], block: int = BLOCK) -> DataFrame:
    """The hashes of each key as arrays of about ``block`` (keys..., __items); the split is by hash, so no task sees a whole key."""
    sizes = items.groupBy(*keys).agg(F.ceil(F.count("*") / block).alias("__blocks"))
    cut = items.join(sizes, list(keys)).withColumn("__block", F.pmod(F.xxhash64("__h"), F.col("__blocks")))
    return cut.groupBy(*keys, "__block").agg(F.collect_list(F.struct("__h", "ord", "id")).alias("__items")).drop("__block")


def _best_in(items: Column, phash: Column) -> Column:
    return F.array_min(F.transform(items, lambda t: F.struct(hamming_bits(phash, t["__h"]).alias("d"), t["ord"].alias("ord"), t["id"].alias("id"))))


def nearest_hashes(probes: DataFrame, targets: DataFrame, keys: Sequence[str], block: int = BLOCK) -> DataFrame:
    """The target with the nearest hash for each distinct probe hash, the first in ``ord`` of equals: (keys..., phash, id, distance).

    probes (keys..., phash BIGINT); targets (keys..., phash BIGINT, ord, id). Two hashes within 4 f + 3 bits agree in one of four bands up to
    f bits, so equal bands settle what lies within 3 bits and bands with one bit turned what lies within 7. What is farther is held
    against the key's targets in blocks. In all steps targets come as arrays and a probe takes the best of an array at once: pairs are never
    rows. Equal hashes of a key count once on both sides. Rows with a NULL hash are left out, as are probes whose key has no target.
    """
    keys = list(keys)
    asked = cut_lineage(probes.where(F.col("phash").isNotNull()).select(*keys, "phash").distinct())
    first = targets.where(F.col("phash").isNotNull()).groupBy(*keys, F.col("phash").alias("__h")).agg(F.min(F.struct("ord", "id")).alias("__t"))
    known = cut_lineage(first.select(*keys, "__h", "__t.ord", "__t.id"))
    banded = in_blocks(known.withColumn("__band", F.explode(band_keys(F.col("__h")))), [*keys, "__band"], block)
    take = lambda met: met.groupBy(*keys, "phash").agg(F.min(_best_in(F.col("__items"), F.col("phash"))).alias("__b"))
    done, open_ = [], asked
    for flips in (0, 1):
        spread = open_.withColumn("__band", F.explode(band_keys(F.col("phash"), flips)))
        found = cut_lineage(take(spread.join(banded, [*keys, "__band"])).where(F.col("__b.d") <= BANDS * flips + BANDS - 1))
        done.append(found)
        open_ = open_.join(found, [*keys, "phash"], "left_anti")
    # the probes of a key are salted, its blocks repeated once per salt
    salts = open_.groupBy(*keys).agg(F.ceil(F.count("*") / block).alias("__salts"))
    salted = open_.join(salts, keys).withColumn("__salt", F.pmod(F.xxhash64("phash"), F.col("__salts"))).drop("__salts")
    blocks = in_blocks(known, keys, block).join(salts, keys).withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__salts") - 1))).drop("__salts")
    done.append(take(salted.join(blocks, [*keys, "__salt"])))
    out = done[0].unionByName(done[1]).unionByName(done[2])
    return out.select(*keys, "phash", F.col("__b.id").alias("id"), F.col("__b.d").alias("distance"))
