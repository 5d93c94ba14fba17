"""Language identification by a string kernel.

The kernel of two texts is the number of byte n-grams (lengths 1 to 4 blended, A-Z lower-cased, hashed into ``BUCKETS``) that both hold,
over the root of the product of how many each holds. Nyström landmarks span the space, one ridge regression per language is fitted
against the rest. As the kernel is a scalar product of presence vectors, landmarks and dual weights fold into one matrix of buckets x
languages, so that scoring a batch is one matrix product of presence rows; ``kernel_scores`` is the same without folding.

Fitting uses a bounded sample (``most`` rows, shared evenly by the languages, of which the ``LANGUAGES`` most frequent count); every whole
text is scored in one pass without a shuffle.

Cases: ``und`` with score 0 for a null text or one without a letter, and for all texts if nothing can be learned; equal scores go to the
language first in order; a null id is never learned from; repeated rows are scored alike; other columns are not read.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import texts as T

BUCKETS = 1 << 15
LONGEST = 4
BLOCK = 256
LANGUAGES = 1000
FOLDS, HELD_OUT = 4, 2
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32


def presence(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Documents x buckets, 1 where the document holds an n-gram of that bucket."""
    n = len(offsets) - 1
    out = np.zeros((n, BUCKETS), np.uint8)
    doc = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
    b = _LOWER[raw] + np.uint32(1)
    code = np.zeros(len(b), np.uint32)
    for size in range(1, LONGEST + 1):
        if len(b) < size:
            break
        code = code[: len(b) - size + 1] * np.uint32(0x01000193) + b[size - 1 :]
        bucket = (code * np.uint32(0x9E3779B1)) >> np.uint32(17)
        flat = doc[: len(code)] * BUCKETS + bucket
        out.ravel()[flat if size == 1 else flat[doc[: len(code)] == doc[size - 1 :]]] = 1
    return out


def blocks(raw: np.ndarray, offsets: np.ndarray):
    for i in range(0, len(offsets) - 1, BLOCK):
        at = offsets[i : i + BLOCK + 1]
        yield presence(raw[at[0] : at[-1]], at - at[0])


def fit(rows: np.ndarray, langs: list[str], landmarks: int = 256, ridge: float = 0.02) -> dict:
    """rows: presence rows; langs: one per row."""
    names = sorted(set(langs))
    if not names:
        return {"names": [], "weights": np.zeros((BUCKETS, 0), np.float32)}
    y = np.array([[float(x == k) for k in names] for x in langs])
    norm = 1 / np.sqrt(np.maximum(1, rows.sum(1, dtype=np.int64)))
    turn = np.empty(len(langs), np.int64)  # landmarks by turns from each language
    for k in range(len(names)):
        own = np.flatnonzero(y[:, k])
        turn[own] = np.arange(len(own))
    chosen = np.sort(np.lexsort((np.arange(len(langs)), turn))[:landmarks])
    base = rows[chosen].astype(np.float32) * norm[chosen, None].astype(np.float32)
    k_nm = np.concatenate([rows[i : i + BLOCK].astype(np.float32) @ base.T for i in range(0, len(rows), BLOCK)]).astype(np.float64) * norm[:, None]
    value, vector = np.linalg.eigh(k_nm[chosen])
    root = (vector * np.where(value > 1e-8 * max(1e-12, value[-1]), 1 / np.sqrt(np.maximum(value, 1e-12)), 0)) @ vector.T
    phi = np.column_stack([k_nm @ root, np.ones(len(rows))])
    weight = (y / y.sum(0)).sum(1) * len(rows) / len(names)  # each language counts the same
    left = phi.T @ (phi * weight[:, None]) + ridge * len(rows) / 100 * np.diag([1.0] * len(chosen) + [1e-6])
    beta = np.linalg.solve(left, phi.T @ (y * weight[:, None]))
    alpha = root @ beta[:-1]
    return {"names": names, "weights": (base.T.astype(np.float64) @ alpha).astype(np.float32), "bias": beta[-1], "landmarks": base, "alpha": alpha}


def folded_scores(model: dict, rows: np.ndarray) -> np.ndarray:
    norm = 1 / np.sqrt(np.maximum(1, rows.sum(1, dtype=np.int64)))
    return (rows.astype(np.float32) @ model["weights"]) * norm[:, None] + model["bias"]


def kernel_scores(model: dict, rows: np.ndarray) -> np.ndarray:
    """The same by the kernel against each landmark; slower, for checks."""
    norm = 1 / np.sqrt(np.maximum(1, rows.sum(1, dtype=np.int64)))
    return ((rows.astype(np.float64) @ model["landmarks"].T.astype(np.float64)) * norm[:, None]) @ model["alpha"] + model["bias"]


def train(documents: DataFrame, most: int = 2000, landmarks: int = 256) -> dict:
    """Learn from text and lang of at most about ``most`` documents that are not held out."""
    rows = documents.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (T.remainder("doc_id", FOLDS) != HELD_OUT))
    each = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    if not each:
        return fit(np.zeros((0, BUCKETS), np.uint8), [])
    per = max(1, most // len(each))
    unit = 1_000_000
    share = F.create_map([F.lit(v) for r in each for v in (r["lang"], min(unit, int(unit * 1.2 * per / r["count"]) + 1))])
    chosen = rows.where(F.abs(F.xxhash64("doc_id") % unit) < share[F.col("lang")])
    got = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(2 * max(most, len(each))).collect()
    taken: dict[str, int] = {}
    kept = [r for r in got if taken.setdefault(r.lang, 0) < per and not taken.update({r.lang: taken[r.lang] + 1})]
    raws = [np.frombuffer(r.text.encode(), np.uint8) for r in kept]
    return fit(np.concatenate([presence(x, np.array([0, len(x)])) for x in raws]), [r.lang for r in kept], landmarks)


def _predict(raw, offsets, model):
    names, data = [], raw.tobytes()
    best = np.zeros(len(offsets) - 1)
    if model["names"]:
        scores = np.concatenate([folded_scores(model, rows) for rows in blocks(raw, offsets)])
        at, best = scores.argmax(1), np.clip(scores.max(1), 0, 1)
    for i in range(len(offsets) - 1):
        ok = model["names"] and any(map(str.isalpha, data[offsets[i] : offsets[i + 1]].decode()))
        names.append(model["names"][at[i]] if ok else "und")
        best[i] = best[i] if ok else 0
    return {"lang_pred": names, "score": best}


def identify(documents: DataFrame, most: int = 2000, landmarks: int = 256) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document."""
    model = train(documents, most, landmarks)
    model = {k: model[k] for k in ("names", "weights", "bias") if k in model}
    out = T.map_texts(documents.select("doc_id", "text"), functools.partial(_predict, model=model), "lang_pred string, score double")
    return out.select("doc_id", F.coalesce(T.remainder("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score")
