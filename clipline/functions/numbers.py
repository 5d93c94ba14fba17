"""Rounding and vector arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_to(c: Column, digits: int = 3) -> Column:
    """Half-even rounding in double arithmetic, so results do not depend on a decimal conversion."""
    scale = float(10**digits)
    return F.rint(c * F.lit(scale)) / F.lit(scale)


def clamp(c: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Signed shared length of two spans; negative when apart."""
    return F.least(a_end, b_end) - F.greatest(a_start, b_start)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v
    )


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two equal-length vectors; 0 for a missing, uneven or zero vector."""
    scale = norm(a) * norm(b)
    ok = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (F.size(a) > 0) & (scale > 0)
    return F.when(ok, dot(a, b) / scale).otherwise(F.lit(0.0))


def unit(a: Column) -> Column:
    """Vector scaled to length 1; a zero vector stays as it is."""
    length = norm(a)
    return F.when(length > 0, F.transform(a, lambda v: v.cast("double") / length)).otherwise(
        F.transform(a, lambda v: v.cast("double"))
    )


def bhattacharyya(a: Column, b: Column) -> Column:
    """Distance sqrt(1 - sum(sqrt(a*b)) / sqrt(sum a * sum b)) of two histograms, 1 if either is empty."""
    sa = F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double"))
    sb = F.aggregate(b, F.lit(0.0), lambda s, v: s + v.cast("double"))
    bc = F.aggregate(
        F.zip_with(a, b, lambda x, y: F.sqrt(x.cast("double") * y.cast("double"))), F.lit(0.0), lambda s, v: s + v
    )
    return F.when((sa > 0) & (sb > 0), F.sqrt(F.greatest(F.lit(0.0), 1 - bc / F.sqrt(sa * sb)))).otherwise(F.lit(1.0))


def hamming_bits(a: Column, b: Column) -> Column:
    """Hamming distance of two 64-bit hashes held as BIGINT."""
    return F.bit_count(a.bitwiseXOR(b))


def pack_bits(bits: Column) -> Column:
    """Fold an array of up to 64 zero/one values into one BIGINT, first element highest."""
    return F.aggregate(
        bits, F.lit(0).cast("bigint"), lambda s, v: F.shiftleft(s, 1).bitwiseOR(F.when(v > 0, 1).otherwise(0).cast("bigint"))
    )


def iou(ax1, ay1, ax2, ay2, bx1, by1, bx2, by2) -> Column:
    """Intersection over union of two boxes; 0 when they do not meet."""
    w = F.greatest(F.lit(0.0), F.least(ax2, bx2) - F.greatest(ax1, bx1))
    h = F.greatest(F.lit(0.0), F.least(ay2, by2) - F.greatest(ay1, by1))
    inter = w * h
    area = (ax2 - ax1) * (ay2 - ay1) + (bx2 - bx1) * (by2 - by1) - inter
    return F.when(area > 0, inter / area).otherwise(F.lit(0.0))
