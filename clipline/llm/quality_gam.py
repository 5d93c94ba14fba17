"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature is cut into bins; cyclic boosting gives one shallow tree at a time to one feature, so that its trees add up to one look-up
table. The pairs that explain most of what is left get two-way tables in the same manner. A document's score is a sum of table entries.

Fitting uses a bounded sample of labelled rows (``most``); scoring reads every whole text in one pass without a shuffle.

Cases: a null or empty text has the features of no words and is scored as such; repeated rows are scored alike; a null id is scored and
never learned from; without labelled rows every score is 0.5; other columns of the inputs are not read.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import texts as T
from .labelled import training_rows
from .statistics import features

FOLDS = 5


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))


def _leaves(g: np.ndarray, h: np.ndarray, depth: int, penalty: float) -> np.ndarray:
    """Values per bin of the best shallow tree for gradient sums g and curvature sums h."""
    out = np.full(len(g), g.sum() / (h.sum() + penalty))
    if depth and len(g) > 1:
        a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gain = a * a / (b + penalty) + (g.sum() - a) ** 2 / (h.sum() - b + penalty)
        at = int(np.argmax(gain)) + 1
        out[:at], out[at:] = _leaves(g[:at], h[:at], depth - 1, penalty), _leaves(g[at:], h[at:], depth - 1, penalty)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, penalty: float) -> np.ndarray:
    """Values per cell of the best tree that cuts both features once."""
    def parts(x):
        c = x.cumsum(0).cumsum(1)
        a, left, low = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1]
        return a, left - a, low - a, c[-1, -1] - left - low + a

    gs, hs = parts(g), parts(h)
    gain = sum(x * x / (y + penalty) for x, y in zip(gs, hs, strict=True))
    out = np.zeros(g.shape)
    if gain.size:
        i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
        for k, (rows, cols) in enumerate(itertools.product((slice(0, i + 1), slice(i + 1, None)), (slice(0, j + 1), slice(j + 1, None)))):
            out[rows, cols] = gs[k][i, j] / (hs[k][i, j] + penalty)
    return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 60, pairs: int = 10, bins: int = 32, coarse: int = 8, rate: float = 0.1, penalty: float = 2.0) -> dict:
    """Bin edges, one table per feature, and tables for the chosen pairs."""
    if not len(y):
        return {"base": 0.0, "edges": [], "tables": [], "pairs": []}
    share = (y.sum() + 1) / (len(y) + 2)
    model = {"base": float(np.log(share / (1 - share))), "edges": [_edges(c, bins) for c in x.T], "pairs": []}
    at = [np.searchsorted(e, c, "right") for e, c in zip(model["edges"], x.T, strict=True)]
    tables = [np.zeros(len(e) + 1) for e in model["edges"]]
    f = np.full(len(y), model["base"])
    for _ in range(rounds):
        for k, b in enumerate(at):
            p = 1 / (1 + np.exp(-f))
            n = len(tables[k])
            step = rate * _leaves(np.bincount(b, y - p, n), np.bincount(b, p * (1 - p), n), 2, penalty)
            tables[k] += step
            f += step[b]
    model["tables"] = tables
    p = 1 / (1 + np.exp(-f))
    rough = [_edges(c, coarse) for c in x.T]
    at = [np.searchsorted(e, c, "right") for e, c in zip(rough, x.T, strict=True)]
    gains = []
    for i, j in itertools.combinations(range(x.shape[1]), 2):
        m = len(rough[j]) + 1
        size = (len(rough[i]) + 1) * m
        g, h = np.bincount(at[i] * m + at[j], y - p, size), np.bincount(at[i] * m + at[j], p * (1 - p), size)
        v = _quadrants(g.reshape(-1, m), h.reshape(-1, m), penalty)
        gains.append((float((v.ravel() * g).sum()), i, j))
    chosen = [(i, j) for _, i, j in sorted(gains, reverse=True)[:pairs]]
    two = [np.zeros((len(rough[i]) + 1, len(rough[j]) + 1)) for i, j in chosen]
    for _ in range(pair_rounds):
        for (i, j), table in zip(chosen, two, strict=True):
            p = 1 / (1 + np.exp(-f))
            cell = at[i] * table.shape[1] + at[j]
            step = rate * _quadrants(np.bincount(cell, y - p, table.size).reshape(table.shape), np.bincount(cell, p * (1 - p), table.size).reshape(table.shape), penalty)
            table += step
            f += step.ravel()[cell]
    model["pairs"] = [(i, j, rough[i], rough[j], t) for (i, j), t in zip(chosen, two, strict=True)]
    return model


def score(model: dict, x: np.ndarray) -> np.ndarray:
    """Probabilities, by adding up table entries."""
    f = np.full(len(x), model["base"])
    for k, (edges, table) in enumerate(zip(model["edges"], model["tables"], strict=True)):
        f += table[np.searchsorted(edges, x[:, k], "right")]
    for i, j, a, b, table in model["pairs"]:
        f += table[np.searchsorted(a, x[:, i], "right"), np.searchsorted(b, x[:, j], "right")]
    return 1 / (1 + np.exp(-f))


def train(documents: DataFrame, labels: DataFrame, most: int = 20_000) -> dict:
    """Fit on at most ``most`` labelled rows outside the held-out fold."""
    return fit(*training_rows(documents, labels, "quality", most))


def _scores(raw, offsets, model, name):
    return {name: score(model, features(raw, offsets))}


def score_documents(documents: DataFrame, model: dict, name: str = "score", drop: tuple[str, ...] = ("text",)) -> DataFrame:
    """Add a score in 0 to 1 to every document."""
    return T.map_texts(documents, functools.partial(_scores, model=model, name=name), f"{name} double", drop)


def quality(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, most: int = 20_000) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    model = train(documents, labels, most)
    out = score_documents(documents.select("doc_id", "text"), model)
    return out.select(
        "doc_id", F.coalesce(T.remainder("doc_id", FOLDS) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents that are not rejected, with their own columns."""
    name = T.free_name(documents, "quality_score")
    scored = score_documents(documents, train(documents, labels), name, ())
    return scored.where(F.col(name) >= threshold).drop(name)
