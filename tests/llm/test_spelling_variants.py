"""Spelling variants against a plain edit test over all pairs of words."""

import collections
import random
import re
import zlib

import pytest

from clipline.llm import spelling_variants as V


def one_apart(a, b):
    """Exactly one inserted, deleted or replaced code point, by trying each place."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_words(docs):
    n = collections.Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]+", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def plain(words):
    near = {w: [v for v in words if one_apart(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return out


def rows(frame):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect()}


def random_words(rng, n):
    out = {}
    while len(out) < n:
        w = "".join(rng.choice("abé") for _ in range(rng.randint(7, 10)))
        out[w] = rng.choice([2, 3, 30, 400, 5000, 60000])
    return out


@pytest.mark.parametrize("wild, block", [(3, 2048), (2, 5), (5, 16)])
def test_all_pairs(spark, wild, block):
    """Few letters, so that groups are large and runs of a letter allow an edit at several places; small blocks cut the groups."""
    words = random_words(random.Random(wild), 400)
    frame = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    formed = V.with_forms(frame, V.near_words(frame, wild, block))
    want = plain(words)
    assert {(r.word, r.form, r.n, r.n_near, r.form_n) for r in formed.collect()} == {(w, f, n, k, m) for w, f, _, n, k, m in want}
    assert {(r.word, r.root) for r in V.roots(formed).collect()} == {(w, r) for w, f, r, *_ in want if f}


def test_documents(spark):
    rng = random.Random(2)
    base = ["straßenbahn", "Ünderstand", "working", "aaaaaaa", "aaaaaaaa", "öffentlich", "÷×÷×÷×÷"]
    docs = [(k, " ".join(rng.choice(base) for _ in range(rng.randint(0, 90))).replace("k", rng.choice("kkkg"))) for k in range(80)]
    docs += [(None, "Working-working, WORKING"), (3, None), (4, ""), (5, "x" * 50_000 + " " + "x" * 50_001), (6, "x" * 50_000 + " " + "x" * 50_001), (5, docs[5][1])]
    frame = spark.createDataFrame([(*d, 1, "a") for d in docs], "doc_id long, text string, n long, word string").repartition(4)
    assert rows(V.variants(frame)) == plain(plain_words(docs))


def test_chains_of_forms(spark):
    words = {"abcdefg": 2, "abcdefgh": 25, "abcdefghi": 300, "abcdefghij": 4000, "abcdefghijk": 50_000}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    assert {r.root for r in V.roots(V.with_forms(frame, V.near_words(frame))).collect()} == {"abcdefghijk"}


def test_odd_documents(cases, none):
    assert rows(V.variants(cases)) == plain(plain_words([(r.doc_id, r.text) for r in cases.collect()]))
    assert rows(V.variants(none)) == set()
