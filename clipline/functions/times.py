"""Time text to seconds and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_seconds(text: Column) -> Column:
    """``HH:MM:SS.cc``, ``MM:SS.ss``, ``12.5s`` or a plain number; unreadable text gives 0.0."""
    bare = F.trim(F.regexp_replace(text.cast("string"), r"[\[\]]", ""))
    parts = F.split(bare, ":")
    whole = lambda i: F.trim(F.get(parts, F.lit(i))).try_cast("int")
    real = lambda i: F.trim(F.get(parts, F.lit(i))).try_cast("double")
    lone = F.regexp_replace(bare, r"[^\d.\-]", "").try_cast("double")
    value = (
        F.when(F.size(parts) == 3, whole(0) * 3600 + whole(1) * 60 + real(2))
        .when(F.size(parts) == 2, whole(0) * 60 + real(1))
        .when(F.size(parts) == 1, lone)
    )
    return F.coalesce(value, F.lit(0.0)).cast("double")


def parse_frame(text: Column) -> Column:
    """``[a -> b]`` to STRUCT<a, b> in seconds; NULL without an arrow."""
    bare = F.trim(F.regexp_replace(text, r"[\[\]]", ""))
    sides = F.split(bare, "->", 2)
    return F.when(
        bare.contains("->"),
        F.struct(parse_seconds(F.get(sides, F.lit(0))).alias("a"), parse_seconds(F.get(sides, F.lit(1))).alias("b")),
    )


def _pad2(c: Column) -> Column:
    return F.format_string("%02d", c.cast("bigint"))


def minutes_text(seconds: Column) -> Column:
    """Seconds as ``MM:SS.ss``."""
    minutes = F.floor(seconds / 60)
    hundredths = F.rint((seconds - minutes * 60) * 100).cast("bigint")
    return F.concat(
        _pad2(minutes), F.lit(":"), _pad2(F.floor(hundredths / 100)), F.lit("."), _pad2(F.pmod(hundredths, F.lit(100)))
    )


def subtitle_stamp(seconds: Column) -> Column:
    """Seconds as ``HH:MM:SS,mmm``."""
    ms = F.greatest(F.lit(0), F.rint(seconds * 1000)).cast("bigint")
    part = lambda unit, base: F.pmod(F.floor(ms / unit), F.lit(base))
    return F.format_string(
        "%02d:%02d:%02d,%03d",
        F.floor(ms / 3600000).cast("bigint"),
        part(60000, 60).cast("bigint"),
        part(1000, 60).cast("bigint"),
        F.pmod(ms, F.lit(1000)),
    )
