"""Labelled rows for fitting: a bounded sample of labels, and the features of their documents."""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import texts as T
from .statistics import features


def sample_of_labels(labels: DataFrame, label: str, most: int, folds: int = 5, held_out: int = 0) -> DataFrame:
    """(id_, label_): at most ``most`` labelled ids outside the held-out fold. A repeated id counts once, with its largest label."""
    rows = labels.select(F.col("doc_id").alias("id_"), F.col(label).alias("label_")).where(F.col("id_").isNotNull() & F.col("label_").isNotNull())
    rows = rows.where(T.remainder("id_", folds) != held_out).groupBy("id_").agg(F.max("label_").alias("label_"))
    return T.bounded_sample(rows, "id_", most)


def _features(raw, offsets):
    return {"features_": [list(x) for x in features(raw, offsets)]}


def training_rows(documents: DataFrame, labels: DataFrame, label: str, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(features, labels) of the sample, which is at most ``most`` rows of a few numbers. The ids are broadcast: their number is bounded."""
    ids = sample_of_labels(labels, label, most)
    docs = documents.select(F.col("doc_id").alias("id_"), "text").join(F.broadcast(ids), "id_")
    rows = T.map_texts(docs, functools.partial(_features), "features_ array<double>").orderBy("id_", "features_").limit(2 * most).collect()
    if not rows:
        return np.zeros((0, 1)), np.zeros(0)
    return np.array([r.features_ for r in rows]), np.array([float(r.label_ > 0) for r in rows])
