"""Statistics of documents, worked out for a slice of texts at once."""

from __future__ import annotations

import numpy as np

from . import texts as T

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"

_CLASS = np.full(256, 9, np.int64)
_CLASS[[9, 11, 12, 13, 32]] = 0
_CLASS[10] = 1
_CLASS[97:123] = 2
_CLASS[65:91] = 3
_CLASS[48:58] = 4
_CLASS[[ord(c) for c in SYMBOLS]] = 5
_CLASS[[ord("!"), ord("?")]] = 6
_CLASS[[ord(c) for c in ".,;:"]] = 7
_CLASS[0x80:0xC0] = 8
_CLASS[0xC0:] = 10
N_CLASSES = 11

NAMES = (
    "log_words log_chars word_length symbol_share upper_share digit_share shout_share stop_share other_share wide_share"
    " repeated_line_share repeated_window_share distinct_word_share top_word_share repeated_pair_share line_words ended_line_share short_word_share lone_symbol_share"
).split()


def counts(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Exact counts per document; ``n_repeat_words`` counts words that lie in an 8-word window found twice or more."""
    n = len(offsets) - 1
    by_class = np.bincount(np.repeat(np.arange(n) * N_CLASSES, np.diff(offsets)) + _CLASS[raw], minlength=n * N_CLASSES).reshape(n, N_CLASSES)
    start, end, doc = T.words(raw, offsets)
    prefix = T.running(T.TABLE[raw])
    h = T.span_hash(prefix, start, end)
    n_words = np.bincount(doc, minlength=n)

    key, first = T.windows(h, doc, 8)
    key, _ = T.with_document(key, doc[first], n)
    found = first[_found_again(key)]
    step = np.zeros(len(h) + 1, np.int64)
    step[found] += 1
    np.subtract.at(step, found + 8, 1)
    repeated = np.bincount(doc[np.cumsum(step[:-1]) > 0], minlength=n)

    a, b, of = T.lines(raw, offsets)
    with_word = np.searchsorted(start, a) < np.searchsorted(start, b)
    a, b, of = a[with_word], b[with_word], of[with_word]
    n_lines = np.bincount(of, minlength=n)
    line_key, shift = T.with_document(T.span_hash(prefix, a, b), of, n)
    distinct_lines = np.bincount((np.unique(line_key) >> shift).astype(np.int64), minlength=n)
    last = raw[np.maximum(b, 1) - 1] if len(b) else np.zeros(0, np.uint8)
    return {
        "n_words": n_words, "word_chars": by_class[:, 2:].sum(1) - by_class[:, 8], "n_symbols": by_class[:, 5], "n_dup_lines": n_lines - distinct_lines,
        "n_repeat_words": repeated, "by_class": by_class, "n_lines": n_lines, "ended_lines": np.bincount(of[_CLASS[last] >= 6], minlength=n) if len(b) else n_lines * 0,
        "word_hash": h, "word_doc": doc, "word_length": end - start, "word_symbol": np.isin(_CLASS[raw[np.minimum(start, len(raw) - 1)]], [5]) if len(start) else np.zeros(0, bool),
    }


def _found_again(key: np.ndarray) -> np.ndarray:
    """Which of the keys occur more than once."""
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    out = np.zeros(len(key), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def features(raw: np.ndarray, offsets: np.ndarray, of: dict[str, np.ndarray] | None = None) -> np.ndarray:
    """A row of ``NAMES`` per document; all zero shares for a text without words."""
    c = counts(raw, offsets) if of is None else of
    n = len(offsets) - 1
    chars = np.maximum(1, c["by_class"].sum(1) - c["by_class"][:, 8])
    words, lines = np.maximum(1, c["n_words"]), np.maximum(1, c["n_lines"])
    key, shift = T.with_document(c["word_hash"], c["word_doc"], n)
    each, times = np.unique(key, return_counts=True)
    each_doc = (each >> shift).astype(np.int64)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, each_doc, times)
    pair, first = T.windows(c["word_hash"], c["word_doc"], 2)
    pair, shift2 = T.with_document(pair, c["word_doc"][first], n)
    pairs = np.bincount((np.unique(pair) >> shift2).astype(np.int64), minlength=n)
    cls = c["by_class"] / chars[:, None]
    return np.column_stack([
        np.log1p(c["n_words"]), np.log1p(chars), c["word_chars"] / words, cls[:, 5], cls[:, 3], cls[:, 4], cls[:, 6], cls[:, 7], cls[:, 9], cls[:, 10],
        c["n_dup_lines"] / lines, c["n_repeat_words"] / words, np.bincount(each_doc, minlength=n) / words, top / words,
        np.where(c["n_words"] > 1, 1 - pairs / np.maximum(1, c["n_words"] - 1), 0), c["n_words"] / lines, c["ended_lines"] / lines,
        np.bincount(c["word_doc"][c["word_length"] <= 2], minlength=n) / words, np.bincount(c["word_doc"][c["word_symbol"]], minlength=n) / words,
    ]).astype(np.float64)
