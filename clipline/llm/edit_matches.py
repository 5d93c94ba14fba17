"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared as words: A-Z lower-cased, white space of any length as one space. A test item of m characters may occur in a document
with up to ``m * percent // 100`` edits. Cut into one piece more than that, at least one piece then occurs exactly, near its place. An
automaton over all pieces finds their exact hits in one pass over the whole text; around each hit Myers' bit-parallel algorithm gives the
least edit distance of the item to any stretch of the text, and where it ends. An item of fewer than ``LEAST`` characters is one piece of
the same automaton and must occur without edits, between word boundaries.

At scale: items are broadcast in blocks of at most ``BLOCK_BYTES`` of text, a pass over the documents per block; documents are never
shuffled. Hits of one item on neighbouring diagonals share one verification.

Cases: null and empty documents and items match nothing, nor do items of fewer than ``LEAST`` characters with no word or a single one, which stand
in ordinary text (a character of a script without spaces is a word); repeated items count once under their smallest id; repeated documents
are reported each; a null document id is carried; other columns are not read.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import texts as T

PERCENT = 5
LEAST = 40
BLOCK_BYTES = 8_000_000

_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af"
_WORD = re.compile(f"[{_UNSPACED}]|[^\\W_{_UNSPACED}]+")
_JOINED = re.compile(f"[^\\W_{_UNSPACED}]{{2}}")

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[[9, 10, 11, 12, 13]] = 32


def normal(text: str) -> str:
    raw = _LOWER[np.frombuffer(text.encode(), np.uint8)]
    if not len(raw):
        return ""
    keep = (raw != 32) | (np.append(0, raw[:-1]) != 32)
    return raw[keep].tobytes().decode().strip(" ")


def pieces(length: int, budget: int) -> list[tuple[int, int]]:
    """``budget`` + 1 spans that cover the item."""
    return [(k * length // (budget + 1), (k + 1) * length // (budget + 1)) for k in range(budget + 1)]


def best_match(item: str, text: str) -> tuple[int, int]:
    """(least edit distance of ``item`` to any stretch of ``text``, where the first such stretch ends), by Myers' bit vectors."""
    m = len(item)
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | (1 << i)
    full, high = (1 << m) - 1, 1 << (m - 1)
    up, down, distance = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        right, left = down | (full & ~(xh | up)), up & xh
        if right & high:
            distance += 1
        elif left & high:
            distance -= 1
        right, left = (right << 1) & full, (left << 1) & full
        up, down = left | (full & ~(xv | right)), right & xv
        if distance < best:
            best, end = distance, j + 1
    return best, end


def sought(item: str) -> bool:
    """Whether a normalised item is looked for: one of ``LEAST`` characters, or of two words."""
    return len(item) >= LEAST or len(_WORD.findall(item)) > 1


def on_boundaries(text: str, start: int, end: int) -> bool:
    """Whether the stretch begins and ends between words, not inside one."""
    return not (start > 0 and _JOINED.match(text, start - 1) or _JOINED.match(text, end - 1))


class Matcher:
    """The automaton over the pieces of a block of items."""

    def __init__(self, items: list[tuple[int, str]], percent: int):
        import ahocorasick

        self.items = items
        self.budget = [len(t) * percent // 100 if len(t) >= LEAST else 0 for _, t in items]
        where: dict[str, list[tuple[int, int]]] = {}
        for k, (_, t) in enumerate(items):
            for a, b in pieces(len(t), self.budget[k]):
                where.setdefault(t[a:b], []).append((k, a))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(item index, distance, end in the normalised text) of the best match of each item within its budget."""
        near: dict[int, set[int]] = {}
        for end, (size, places) in self.automaton.iter(text):
            for k, at in places:
                near.setdefault(k, set()).add(end + 1 - size - at)
        out = []
        for k, starts in near.items():
            item, budget, best = self.items[k][1], self.budget[k], None
            if len(item) < LEAST:
                ends = [s + len(item) for s in starts if on_boundaries(text, s, s + len(item))]
                if ends:
                    out.append((k, 0, min(ends)))
                continue
            low = high = None
            for s in [*sorted(starts), None]:
                if low is not None and (s is None or s > high + 2 * budget + 1):
                    a = max(0, low - budget)
                    d, e = best_match(item, text[a : high + len(item) + 2 * budget])
                    if d <= budget and (best is None or d < best[0]):
                        best = (d, a + e)
                    low = None
                if low is None:
                    low = s
                high = s
            if best:
                out.append((k, *best))
        return out


_matchers: dict[tuple, Matcher] = {}


def _matcher(items: list[tuple[int, str]], percent: int) -> Matcher:
    key = (percent, len(items), hash(tuple(items)))
    if key not in _matchers:
        _matchers.clear()
        _matchers[key] = Matcher(items, percent)
    return _matchers[key]


def _normalised(batches):
    for b in batches:
        items = [normal(t) for t in b.column(1).to_pylist()]
        keep = [k for k, t in enumerate(items) if sought(t)]
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), pa.array([items[k] for k in keep], pa.string())], names=["item_id", "item"])


def items_of(benchmark: DataFrame) -> DataFrame:
    """(item, item_id): the test items that are looked for, normalised, each once under its smallest id."""
    rows = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    return rows.mapInArrow(_normalised, "item_id long, item string").groupBy("item").agg(F.min("item_id").alias("item_id"))


def blocks_of(benchmark: DataFrame, size: int | None = None) -> list[list[tuple[int, str]]]:
    """The test items in blocks of about ``size`` characters (``BLOCK_BYTES``); where a block ends changes no result."""
    limit, out, filled = BLOCK_BYTES if size is None else size, [[]], 0
    for r in items_of(benchmark).orderBy("item_id", "item").toLocalIterator():
        if filled + len(r["item"]) > limit and out[-1]:
            out.append([])
            filled = 0
        out[-1].append((r.item_id, r["item"]))
        filled += len(r["item"])
    return [b for b in out if b]


def matches(documents: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, item_id, distance, match_end): the best match of each item in each document, within the error budget.

    ``match_end`` counts characters of the normalised text.
    """
    kind = documents.schema["doc_id"].dataType
    schema = StructType([StructField("doc_id", kind), StructField("item_id", LongType()), StructField("distance", LongType()), StructField("match_end", LongType())])

    def run(batches, items):
        matcher = _matcher(items, percent)
        for b in batches:
            ids, column = b.column(b.schema.get_field_index("doc_id")), pc.fill_null(b.column(b.schema.get_field_index("text")), "")
            at, found = [], []
            for i in range(b.num_rows):
                for k, d, e in matcher.find(normal(column[i].as_py())):
                    at.append(i)
                    found.append((items[k][0], d, e))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), *[pa.array([f[c] for f in found], pa.int64()) for c in range(3)]], names=schema.names)

    docs = documents.select("doc_id", "text")
    parts = [docs.mapInArrow(functools.partial(run, items=block), schema) for block in blocks_of(benchmark)]
    return functools.reduce(DataFrame.unionAll, parts) if parts else docs.sparkSession.createDataFrame([], schema)


def _contaminated(raw, offsets, items, percent, name):
    matcher, data = _matcher(items, percent), raw.tobytes()
    return {name: np.array([bool(matcher.find(normal(data[a:b].decode()))) for a, b in zip(offsets[:-1], offsets[1:], strict=True)])}


def keep_clean(documents: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents without any match, with their own columns."""
    name = T.free_name(documents, "contaminated")
    for block in blocks_of(benchmark):
        documents = T.map_texts(documents, functools.partial(_contaminated, items=block, percent=percent, name=name), f"{name} boolean", ()).where(~F.col(name)).drop(name)
    return documents
