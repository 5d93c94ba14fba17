"""Quality rules: gradient-boosted trees over document statistics, flattened into node arrays.

Base rules are exact counts; the verdict of the trees decides the documents that pass them. All trees are complete and of one depth, so
that node arrays hold them and scoring is a few array look-ups per level. Splits on chosen features must go one way (``MONOTONE``), and
the bound between two children holds for all below them.

Cases: a null or empty text has no words and fails the base rules; repeated rows count each for itself; a null id is scored and never
learned from; without labelled rows every score is 0.5; other columns of the inputs are not read.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame

from . import texts as T
from .labelled import training_rows
from .statistics import NAMES, counts, features

#: The score may only fall as these grow.
MONOTONE = {NAMES.index(k): -1 for k in ("symbol_share", "shout_share", "repeated_line_share", "repeated_window_share", "lone_symbol_share")}
MIN_WORDS, MOST_REPEATED = 20, 30


def fit(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 3, bins: int = 32, rate: float = 0.12, penalty: float = 2.0, monotone: dict[int, int] | None = None) -> dict:
    """Node arrays: ``feature`` and ``cut`` (trees x inner nodes), ``value`` (trees x leaves)."""
    monotone = MONOTONE if monotone is None else monotone
    inner, n_leaves = 2**depth - 1, 2**depth
    model = {"base": 0.0, "feature": np.zeros((0, inner), np.int64), "cut": np.zeros((0, inner)), "value": np.zeros((0, n_leaves)), "depth": depth}
    if not len(y):
        return model
    share = (y.sum() + 1) / (len(y) + 2)
    model["base"] = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
    at = np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)])
    f = np.full(len(y), model["base"])
    grown = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)
        feature, cut, value = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n_leaves)
        rows, low, high = {0: np.arange(len(y))}, {0: -np.inf}, {0: np.inf}
        for node in range(inner):
            own = rows.pop(node)
            best = (1e-6, 0, -1, low[node], high[node], None)
            for k in range(x.shape[1]):
                n = len(edges[k])
                if not n or not len(own):
                    continue
                gs, hs = np.bincount(at[own, k], g[own], n + 1), np.bincount(at[own, k], h[own], n + 1)
                a, b = np.cumsum(gs)[:-1], np.cumsum(hs)[:-1]
                left, right = np.clip(a / (b + penalty), low[node], high[node]), np.clip((gs.sum() - a) / (hs.sum() - b + penalty), low[node], high[node])
                whole = np.clip(gs.sum() / (hs.sum() + penalty), low[node], high[node])

                def worth(v, gg, hh):
                    return 2 * v * gg - v * v * (hh + penalty)

                gain = worth(left, a, b) + worth(right, gs.sum() - a, hs.sum() - b) - worth(whole, gs.sum(), hs.sum())
                if k in monotone:
                    gain[monotone[k] * (right - left) < 0] = -np.inf
                i = int(np.argmax(gain))
                if gain[i] > best[0]:
                    best = (float(gain[i]), k, i, left[i], right[i], k in monotone)
            _, k, i, left, right, bound = best
            children = (2 * node + 1, 2 * node + 2)
            if i >= 0:
                feature[node], cut[node] = k, edges[k][i]
                goes = at[own, k] > i
            else:
                goes = np.zeros(len(own), bool)
            middle = (left + right) / 2
            for side, child in enumerate(children):
                rows[child] = own[goes == bool(side)]
                low[child], high[child] = low[node], high[node]
                if i >= 0 and bound:
                    upper = (monotone[k] > 0) == bool(side)
                    low[child], high[child] = (middle, high[node]) if upper else (low[node], middle)
        for leaf in range(n_leaves):
            own = rows[inner + leaf]
            value[leaf] = rate * np.clip(g[own].sum() / (h[own].sum() + penalty), low[inner + leaf], high[inner + leaf])
            f[own] += value[leaf]
        grown.append((feature, cut, value))
    model["feature"], model["cut"], model["value"] = (np.array(part) for part in zip(*grown, strict=True))
    return model


def score(model: dict, x: np.ndarray) -> np.ndarray:
    """Probabilities: all trees at once, one level after the other."""
    n_trees = len(model["feature"])
    node = np.zeros((len(x), n_trees), np.int64)
    tree, row = np.arange(n_trees)[None, :], np.arange(len(x))[:, None]
    for _ in range(model["depth"]):
        node = 2 * node + 1 + (x[row, model["feature"][tree, node]] > model["cut"][tree, node])
    f = model["base"] + model["value"][tree, node - model["feature"].shape[1]].sum(1)
    return 1 / (1 + np.exp(-f))


def train(documents: DataFrame, labels: DataFrame, most: int = 20_000) -> dict:
    """Fit on at most ``most`` labelled rows outside the held-out fold."""
    return fit(*training_rows(documents, labels, "quality", most))


def _judge(raw, offsets, model, threshold):
    c = counts(raw, offsets)
    failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MOST_REPEATED * c["n_words"])
    s = score(model, features(raw, offsets, c))
    return {k: c[k].astype(np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")} | {"base_failed": failed, "score": s, "kept": ~failed & (s >= threshold)}


def quality_rules(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, most: int = 20_000) -> DataFrame:
    """(doc_id, five counts, base_failed, score, kept) of every document, in one pass without a shuffle."""
    model = train(documents, labels, most)
    added = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"
    return T.map_texts(documents.select("doc_id", "text"), functools.partial(_judge, model=model, threshold=threshold), added)
