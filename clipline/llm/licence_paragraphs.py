"""Licence scans: a classifier of word windows trained on licence wording, confirmed against templates.

A paragraph is a run of lines with words; a line without a letter or digit ends it, so comment marks and line ends inside a notice do not
count. Its words and word pairs (A-Z lower-cased) are hashed into ``BUCKETS``; a multinomial logistic regression over the licence families
and ``unknown`` gives probabilities for every line and for sliding windows of ``SPANS`` words. It is trained here: on the templates'
sentences and stretches of them, set among ordinary words, for the families, and on a bounded sample of lines that show no licence wording
for ``unknown``. A temperature and the least probability of a family are calibrated on a part of that set which training leaves out, so
that at most ``FALSE_SHARE`` of its lines and windows pass. Each template slides over the paragraph too: the share of its word pairs that
a window of its own length holds is the overlap, and ``LEAST_OVERLAP`` of them confirm the family, unless another family is likelier there.
What overlaps is reported once, the best confirmed stretch first, as the whole lines that hold it.

One pass over whole texts without a shuffle; the weights are one array of fixed size.

Cases: null and empty texts and lines without words give no row; ties between families go to the first in order; repeated rows are
reported each; a null id is carried; very long lines are read whole; two families on one line give two rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from . import texts as T

#: Short notices by licence family, as they stand in files.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Licensed under the 3-Clause BSD License.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "Licensed under the GNU GPL v3 or later.",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
    ],
    "AGPL": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, Version 2.0.",
    ],
    "CC": [
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "ISC": [
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "EPL": [
        "Licensed under the Eclipse Public License, version 2.0.",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License.",
    ],
    "Zlib": [
        "Licensed under the zlib License.",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    ],
    "Boost": [
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
}
FAMILIES = ["unknown", *TEMPLATES]
BUCKETS = 1 << 16
FALSE_SHARE = 0.001
LEAST_OVERLAP = 0.6
SPANS = ((12, 4), (32, 8))  # words of a window, words between two
_HINTS = ("licen", "copyright", "public domain", "permission", "redistribut")


def paragraphs(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Lines with words (``start``, ``end``, ``doc``, ``first`` word), words (``h``, ``line``, ``block``) and word pairs (``pair``, ``at``)."""
    start, end, doc = T.words(raw, offsets)
    a, b, line_doc = T.lines(raw, offsets)
    # punctuation around a word does not count, nor a word of nothing else
    inside = np.flatnonzero(_WORDLIKE[raw])
    before = np.concatenate([[0], np.cumsum(_WORDLIKE[raw])])
    low, high = before[start], before[end]
    some = low < high
    start, s, e = start[some], inside[low[some]], inside[high[some] - 1] + 1
    h = T.span_hash(T.running(T.LOWER_TABLE[raw]), s, e)
    kept, line = np.unique(np.searchsorted(a, start, "right") - 1, return_inverse=True)
    first = np.searchsorted(line, np.arange(len(kept)))
    opens = np.ones(len(kept), bool)
    opens[1:] = (np.diff(kept) > 1) | (np.diff(line_doc[kept]) > 0)
    block = (np.cumsum(opens) - 1)[line]
    pair, at = T.windows(h, block, 2)
    return {"start": a[kept], "end": b[kept], "doc": line_doc[kept], "first": first, "h": h, "line": line, "block": block, "pair": pair, "at": at}


def units(p: dict) -> tuple[np.ndarray, np.ndarray]:
    """(first word, end word) of every line and of the sliding windows of every paragraph."""
    n = len(p["h"])
    low, high = [p["first"]], [np.append(p["first"][1:], n)]
    begin = np.flatnonzero(np.diff(p["block"], prepend=-1))
    size = np.diff(np.append(begin, n))
    for words, step in SPANS:
        times = 1 + np.maximum(0, -(-(size - words) // step))
        nth = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        low.append(np.repeat(begin, times) + np.minimum(nth * step, np.repeat(np.maximum(0, size - words), times)))
        high.append(np.minimum(low[-1] + words, np.repeat(begin + size, times)))
    return np.concatenate(low), np.concatenate(high)


_WORDLIKE = np.zeros(256, bool)
_WORDLIKE[48:58] = _WORDLIKE[65:91] = _WORDLIKE[97:123] = True
_WORDLIKE[128:] = True


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(48)).astype(np.int64)


def _buckets(p: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, bucket) of the features, and the weight of a feature by line, where every line is a text of its own."""
    key = np.sort(np.concatenate([p["line"] * BUCKETS + _bucket(p["h"]), p["line"][p["at"]] * BUCKETS + _bucket(p["pair"])]))
    line = key // BUCKETS
    return line, key % BUCKETS, 1 / np.sqrt(np.maximum(1, np.bincount(line, minlength=len(p["start"]))))


def _logits(weights: np.ndarray, p: dict, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Stretches of words x families."""
    word, pair = _bucket(p["h"]), _bucket(p["pair"])
    value, out = 1 / np.sqrt(2 * (high - low) - 1), np.empty((len(low), weights.shape[1]))
    for k, own in enumerate(np.ascontiguousarray(weights.T)):
        pairs = np.zeros(len(word))
        pairs[p["at"]] = own[pair]
        total = np.concatenate([[0.0], np.cumsum(own[word] + pairs)])
        out[:, k] = (total[high] - total[low] - pairs[high - 1]) * value + own[-1]
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def _as_slice(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [x.replace("\n", " ").encode() for x in lines]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])


def fit(unknown: list[str], rounds: int = 100, rate: float = 2.0, decay: float = 1e-4, seed: int = 5) -> dict:
    """Weights, temperature and the least probability of a family; ``unknown`` are paragraphs without licence wording."""
    rng = np.random.default_rng(seed)
    around = np.array([w for x in unknown for w in x.split()] or ["text"], object)
    lines, labels = list(unknown) or ["text"], [0] * max(1, len(unknown))
    for k, family in enumerate(TEMPLATES, 1):
        for sentence in TEMPLATES[family]:
            words = sentence.split()
            for i in range(60):
                own = words if i % 3 else words[: max(5, int(rng.integers(len(words) // 2, len(words) + 1)))]
                before, after = (list(rng.choice(around, int(rng.integers(0, 8)))) for _ in range(2))
                lines.append(" ".join([*before, *own, *after]))
                labels.append(k)
            # words of the sentence out of order say nothing about a licence
            lines.append(" ".join(rng.choice([*words, *around[:200]], min(12, len(words) + 4))))
            labels.append(0)
    y = np.array(labels)
    p = paragraphs(*_as_slice(lines))
    y = y[p["doc"]]
    line, bucket, value = _buckets(p)
    used, bucket = np.unique(bucket, return_inverse=True)  # only these weights move
    left_out = np.arange(len(y)) % 5 == 4
    hot = np.eye(len(FAMILIES))[y]
    balance = np.where(left_out, 0, 1 / np.maximum(1, hot[~left_out].sum(0))[y])
    balance /= balance.sum()
    weights = np.zeros((len(used) + 1, len(FAMILIES)))
    squares = np.full(weights.shape, 1e-8)
    by_bucket = np.argsort(bucket, kind="stable")
    bucket_at, line_at = np.searchsorted(bucket[by_bucket], np.arange(len(used))), np.searchsorted(line, np.arange(len(y)))
    for _ in range(rounds):
        logits = np.add.reduceat(weights[bucket], line_at, axis=0) * value[:, None] + weights[-1]
        error = (_softmax(logits) - hot) * balance[:, None]
        step = np.vstack([np.add.reduceat((error * value[:, None])[line[by_bucket]], bucket_at, axis=0), error.sum(0)]) + decay * weights / len(FAMILIES)
        squares += step * step
        weights -= rate * step / np.sqrt(squares) * 0.1
    full = np.zeros((BUCKETS + 1, len(FAMILIES)), np.float32)
    full[used], full[-1] = weights[:-1], weights[-1]
    z = _logits(full, p, p["first"], np.append(p["first"][1:], len(p["h"])))[left_out]
    target = y[left_out]
    heats = np.geomspace(0.3, 5, 25)
    heat = min(heats, key=lambda t: -np.log(np.maximum(1e-12, _softmax(z / t)[np.arange(len(z)), target])).mean())
    low, high = units(p)
    plain = left_out[p["line"][low]] & (y[p["line"][low]] == 0)
    best = _softmax(_logits(full, p, low[plain], high[plain]) / heat)[:, 1:].max(1)
    least = max(0.5, float(np.quantile(best, 1 - FALSE_SHARE)) if len(best) else 0.5)
    return {"weights": full, "heat": float(heat), "least": min(least, 0.99)}


def train(documents: DataFrame, most: int = 2000) -> dict:
    """Learn from the templates and at most ``most`` ordinary paragraphs, drawn by a hash of the paragraph."""
    rows = documents.select(F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line")).where(F.trim("line") != "")
    low = F.lower("line")
    for hint in _HINTS:
        rows = rows.where(~low.contains(hint))
    n = documents.count()
    share = min(1_000_000, int(1_000_000 * most / max(1, 4 * n)) + 1)
    rows = rows.where(F.abs(F.xxhash64("line") % 1_000_000) < share).orderBy(F.xxhash64("line"), "line").limit(most)
    return fit([r["line"] for r in rows.collect()])


class Templates:
    """The word pairs of all templates, and where paragraphs hold enough of one."""

    def __init__(self):
        self.family = [k for k, own in enumerate(TEMPLATES.values(), 1) for _ in own]
        pairs = [np.unique(paragraphs(*_as_slice([s]))["pair"]) for own in TEMPLATES.values() for s in own]
        self.words = [len(paragraphs(*_as_slice([s]))["h"]) for own in TEMPLATES.values() for s in own]
        self.pairs = np.unique(np.concatenate(pairs))
        self.has = [np.isin(self.pairs, x) for x in pairs]

    def hits(self, p: dict) -> tuple[np.ndarray, np.ndarray]:
        """(word, pair number) of the pairs that some template has."""
        number = np.minimum(np.searchsorted(self.pairs, p["pair"]), len(self.pairs) - 1)
        found = self.pairs[number] == p["pair"]
        return p["at"][found], number[found]

    def windows(self, p: dict, word: np.ndarray, number: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(first word, end word, family, overlap) of the windows of a template's length with ``LEAST_OVERLAP`` of its pairs."""
        out = []
        for t, has in enumerate(self.has):
            own = has[number]
            at, what = word[own], number[own]
            need = int(np.ceil(LEAST_OVERLAP * has.sum() - 1e-9))
            if len(at) < need:
                continue
            first, last = at[: len(at) - need + 1], at[need - 1 :]
            near = np.flatnonzero((last - first < self.words[t] - 1) & (p["block"][first] == p["block"][last]))
            ends = np.searchsorted(at, at[near] + self.words[t] - 1)
            for i, j in zip(near.tolist(), ends.tolist(), strict=True):
                j = i + int(np.searchsorted(p["block"][at[i:j]], p["block"][at[i]], "right"))
                share = len(set(what[i:j].tolist())) / int(has.sum())
                if share >= LEAST_OVERLAP:
                    out.append((int(at[i]), int(at[j - 1]) + 2, self.family[t], share))
        return out

    def overlap(self, family: int, word: np.ndarray, number: np.ndarray) -> float:
        """The largest share of a template of the family in a window of its length, among the hits of one stretch."""
        best = 0.0
        for t, has in enumerate(self.has):
            if self.family[t] == family:
                own = has[number]
                at, what = word[own], number[own].tolist()
                ends = np.searchsorted(at, at + self.words[t] - 1).tolist()
                best = max(best, *(len(set(what[i:j])) / int(has.sum()) for i, j in enumerate(ends)), 0.0)
        return best


def notices(p: dict, model: dict, templates: Templates) -> list[tuple[int, int, int, float, float]]:
    """(first line, last line, family, probability, overlap) of what passes, each stretch once, in order."""
    word, number = templates.hits(p)
    sure = templates.windows(p, word, number)
    low, high = units(p)
    n = len(low)
    low, high = np.concatenate([low, np.array([x[0] for x in sure], np.int64)]), np.concatenate([high, np.array([x[1] for x in sure], np.int64)])
    z = _logits(model["weights"], p, low, high) / model["heat"]
    likely = np.flatnonzero((z[:, 1:].max(1) > z[:, 0]) | (np.arange(len(z)) >= n))
    chance = dict(zip(likely.tolist(), _softmax(z[likely]), strict=True))
    found = []
    for i, c in chance.items():
        a, b = int(low[i]), int(high[i])
        k = 1 + int(c[1:].argmax())
        if i >= n:
            if sure[i - n][2] == k:
                found.append((True, sure[i - n][3], float(c[k]), a, b, k))
        elif c[k] >= model["least"]:
            x, y = np.searchsorted(word, [a, b - 1])
            share = templates.overlap(k, word[x:y], number[x:y])
            found.append((share >= LEAST_OVERLAP, share, float(c[k]), a, b, k))
    by_block: dict[int, list] = {}
    for f in found:
        by_block.setdefault(int(p["block"][f[3]]), []).append(f)
    out = []
    for _, own in sorted(by_block.items()):
        taken: list[tuple] = []
        for ok, share, c, a, b, k in sorted(own, key=lambda f: (not f[0], -f[1] if f[0] else 0.0, -f[2], f[4] - f[3], f[3], f[5])):
            first, last = int(p["line"][a]), int(p["line"][b - 1])
            if not any((a < y and x < b) or (k == of and first <= v and u <= last) for x, y, of, u, v, *_ in taken):
                taken.append((a, b, k, first, last, c, share))
        out += sorted((first, last, k, c, share) for _, _, k, first, last, c, share in taken)
    return out


def scan(documents: DataFrame, most: int = 2000) -> DataFrame:
    """(doc_id, start, end, family, probability, overlap, confirmed): the lines of each notice that passes, with byte offsets in the text."""
    model = train(documents, most)
    kind = documents.schema["doc_id"].dataType
    schema = StructType([
        StructField("doc_id", kind), StructField("start", LongType()), StructField("end", LongType()), StructField("family", StringType()),
        StructField("probability", DoubleType()), StructField("overlap", DoubleType()), StructField("confirmed", BooleanType()),
    ])

    def run(batches):
        templates = Templates()
        for b in batches:
            ids = b.column(b.schema.get_field_index("doc_id"))
            for i, j, raw, offsets in T.slices(b.column(b.schema.get_field_index("text"))):
                p = paragraphs(raw, offsets)
                if not len(p["start"]):
                    continue
                found = notices(p, model, templates)
                first, last = (np.array([f[c] for f in found], np.int64) for c in range(2))
                doc = p["doc"][first]
                yield pa.RecordBatch.from_arrays([
                    ids.slice(i, j - i).take(pa.array(doc)), pa.array(p["start"][first] - offsets[doc]), pa.array(p["end"][last] - offsets[doc]),
                    pa.array([FAMILIES[f[2]] for f in found], pa.string()), *[pa.array([f[c] for f in found], pa.float64()) for c in (3, 4)],
                    pa.array([f[4] >= LEAST_OVERLAP for f in found], pa.bool_()),
                ], names=schema.names)

    return documents.select("doc_id", "text").mapInArrow(run, schema)
