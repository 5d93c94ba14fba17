"""Document statistics, the quality operators and the shared text arrays, against plain Python."""

import collections
import random
import re

import numpy as np
import pytest

from clipline.llm import quality_gam, quality_trees, statistics, texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    words = WORD.findall(text)
    windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def as_slice(items):
    raw = [x.encode() for x in items]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)


def some_texts():
    rng = random.Random(8)
    out = ["", " ", "\n\n", "a", "a b c d e f g h a b c d e f g h", "x\nx\n\nx \n x"]
    for _ in range(150):
        out.append("".join(rng.choice(["a", "b", "c ", " ", "\n", "é", "#", "|", " ", "\t", "a b c d e f g h ", "世"]) for _ in range(rng.randint(0, 120))))
    return out


def test_counts():
    items = some_texts()
    c = statistics.counts(*as_slice(items))
    got = list(zip(*(c[k].tolist() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), strict=True))
    assert got == [plain_counts(t) for t in items]


def test_slices_do_not_matter():
    items = some_texts()
    whole = statistics.features(*as_slice(items))
    parts = np.concatenate([statistics.features(*as_slice([t])) for t in items])
    assert np.allclose(whole, parts)


def test_span_hash_depends_on_content_only():
    raw = np.frombuffer(b"abc abcabc", np.uint8)
    prefix = texts.running(texts.TABLE[raw])
    at = np.array([0, 4, 7])
    assert len(set(texts.span_hash(prefix, at, at + 3).tolist())) == 1
    assert texts.span_hash(prefix, np.array([1]), np.array([4]))[0] != texts.span_hash(prefix, np.array([0]), np.array([3]))[0]


def test_gam_learns_a_pair():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_gam.fit(x, y, rounds=20, pairs=3)
    assert ((quality_gam.score(model, x) > 0.5) == y).mean() > 0.95


def test_trees_keep_their_direction_and_match_a_walk():
    rng = np.random.default_rng(2)
    x = rng.random((2000, 3))
    y = (x[:, 0] + rng.normal(0, 0.3, 2000) < 0.5).astype(float)
    model = quality_trees.fit(x, y, trees=40, monotone={0: -1})
    probe = np.column_stack([np.linspace(0, 1, 200), np.full(200, 0.3), np.full(200, 0.6)])
    assert (np.diff(quality_trees.score(model, probe)) <= 1e-12).all()

    def walk(row):
        f = model["base"]
        for feature, cut, value in zip(model["feature"], model["cut"], model["value"], strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + int(row[feature[node]] > cut[node])
            f += value[node - len(feature)]
        return 1 / (1 + np.exp(-f))

    assert np.allclose(quality_trees.score(model, x[:50]), [walk(r) for r in x[:50]])
    assert ((quality_trees.score(model, x) > 0.5) == y).mean() > 0.7


@pytest.mark.parametrize("fn", [quality_gam.quality, quality_trees.quality_rules])
def test_odd_documents(cases, labels, none, fn):
    got = fn(cases, labels).collect()
    assert len(got) == cases.count()
    assert all(0 <= r.score <= 1 for r in got)
    assert fn(none, labels).count() == 0
    assert {r.score for r in fn(cases, labels.limit(0)).collect()} == {0.5}


def test_base_rules(cases, labels):
    want = collections.Counter((r.doc_id, *plain_counts(r.text or "")) for r in cases.collect())
    got = quality_trees.quality_rules(cases, labels).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept) for r in got)


def test_rejected_documents_go_with_their_rows(cases, labels):
    kept = quality_gam.keep_good(cases, labels)
    scores = quality_gam.quality(cases, labels)
    assert kept.columns == cases.columns
    assert kept.count() == scores.where("predicted = 1").count()


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.1"])
def test_held_out_quality(spark, folder):
    scored = quality_gam.quality(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    rows = scored.where("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
