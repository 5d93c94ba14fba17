"""Many texts at once: byte, word and line arrays over Arrow's own buffers, and the pass that maps them.

A pass reads Arrow batches, walks them in slices of about ``SLICE`` bytes (one document at least), and never makes a Python string
unless the operator asks for one. A null text counts as empty throughout.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SLICE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def _table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


TABLE = _table(7)
LOWER_TABLE = TABLE.copy()
LOWER_TABLE[65:91] = TABLE[97:123]
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), wrapping at 64 bits; kept up to the usual slice."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.empty(max(n, 1 << 16), np.uint64)
        have[0] = 1
        have[1:] = base
        np.cumprod(have, out=have)
        if n <= 4 * SLICE:
            _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def running(values: np.ndarray, base: np.uint64 = _BASE) -> np.ndarray:
    """Prefix sums from which the hash of any span follows in two look-ups."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, inverse: np.uint64 = _BASE_INVERSE) -> np.ndarray:
    """64-bit hashes of the spans [start, end); equal content gives equal hashes wherever it stands."""
    return mix((prefix[end] - prefix[start]) * powers(inverse, len(prefix))[start])


def windows(h: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` consecutive words of one document, and the index of each one's first word."""
    if len(h) < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.flatnonzero(doc[: len(doc) - size + 1] == doc[size - 1 :])
    return span_hash(running(h), first, first + size), first


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about ``limit`` bytes."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    if not len(column):
        return
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        j = min(j, len(column))
        yield i, j, raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of the maximal runs of true bytes, never across documents."""
    if not len(inside):
        none = np.zeros(0, np.int64)
        return none, none, none
    edge = np.zeros(len(inside) + 1, bool)
    edge[offsets] = True
    before, after = edge[:-1].copy(), edge[1:].copy()
    before[1:] |= ~inside[:-1]
    after[:-1] |= ~inside[1:]
    start = np.flatnonzero(inside & before)
    return start, np.flatnonzero(inside & after) + 1, np.searchsorted(offsets, start, "right") - 1


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of the words ``[^\\x20\\x09-\\x0D]+``."""
    return runs(~SPACE[raw], offsets)


def lines(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of the \\n-separated lines, empty ones included."""
    cut = np.flatnonzero(raw == 10)
    start = np.sort(np.concatenate([offsets[:-1], cut + 1]), kind="stable")
    end = np.sort(np.concatenate([offsets[1:], cut]), kind="stable")
    doc = np.sort(np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, cut, "right") - 1]), kind="stable")
    return start, end, doc


def with_document(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.uint64]:
    """Keys that sort by document, then hash; and the shift that gives the document back."""
    bits = np.uint64(max(1, int(n - 1).bit_length()) if n > 1 else 1)
    return (doc.astype(np.uint64) << (np.uint64(64) - bits)) | (h >> bits), np.uint64(64) - bits


def map_texts(df: DataFrame, fn: Callable, added: str, drop: tuple[str, ...] = ("text",), column: str = "text") -> DataFrame:
    """Append to each row what ``fn(raw, offsets)`` gives for its text: a dict of arrays or lists, one per column of ``added`` (DDL).

    The other columns pass unchanged, those in ``drop`` go. Row order and row count stay.
    """
    extra = StructType.fromDDL(added)
    kept = [f for f in df.schema.fields if f.name not in drop]
    names = [f.name for f in kept]

    def run(batches):
        for batch in batches:
            got = {f.name: [] for f in extra.fields}
            for _, _, raw, offsets in slices(batch.column(batch.schema.get_field_index(column))):
                for name, values in fn(raw, offsets).items():
                    got[name].append(values)
            if not batch.num_rows:
                continue
            out = [batch.column(batch.schema.get_field_index(n)) for n in names]
            for f in extra.fields:
                parts = got[f.name]
                if isinstance(parts[0], np.ndarray):
                    out.append(pa.array(np.concatenate(parts)))
                else:
                    out.append(pa.array([x for p in parts for x in p]))
            target = [*[batch.schema.field(n).type for n in names], *[_ARROW[f.dataType.simpleString()] for f in extra.fields]]
            yield pa.RecordBatch.from_arrays([a.cast(t) if a.type != t else a for a, t in zip(out, target, strict=True)], names=[*names, *got])

    return df.mapInArrow(run, StructType([*kept, *extra.fields]))


_ARROW = {
    "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(),
    "array<double>": pa.list_(pa.float64()), "array<bigint>": pa.list_(pa.int64()),
}


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores as make it differ from the columns of ``df``, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def remainder(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.col(column).cast("string")) % n


def bounded_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows, chosen by a hash of ``key``: all of them if they are no more, else a fixed share that is drawn evenly.

    The rows are counted first, so that only the chosen share reaches the final cut.
    """
    n = df.count()
    if n > most:
        share = min(1.0, 1.2 * most / n)
        df = df.where(F.abs(F.xxhash64(F.col(key)) % 1_000_000) < int(share * 1_000_000) + 1)
        df = df.orderBy(F.xxhash64(F.col(key)), F.col(key)).limit(most)
    return df
