"""Near-duplicates, components and suffix dedup against brute force."""

import hashlib
import random
import re

import numpy as np

from clipline.llm import setsketch as N
from clipline.llm import suffix_repeats as R
from clipline.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, size):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)])


def brute_groups(pairs, size, percent):
    sets = [shingles(t, size) for _, t in pairs]
    root = list(range(len(pairs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(pairs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(pairs):
        ids = [pairs[j][0] for j in range(len(pairs)) if find(j) == find(i) and pairs[j][0] is not None]
        out.append((doc, len(sets[i]), min(ids) if ids and sets[i] else doc))
    return out


def family(rng, sentence, n_bases=12, copies=14):
    out = []
    for _ in range(n_bases):
        base = sentence(rng, rng.randint(30, 120)).split()
        for _ in range(rng.randint(1, copies)):
            own = list(base)
            for _ in range(rng.randint(0, 5)):
                own[rng.randrange(len(own))] = rng.choice(["xx", "yy", "The", "zz"])
            out.append(" ".join(own))
    return out


def test_groups_against_brute_force(spark, sentence):
    rng = random.Random(12)
    items = family(rng, sentence)
    passage = sentence(rng, 40)
    items += [passage + " " + sentence(rng, 20) for _ in range(30)] + ["", None, " \n", "one two", "One Two", "one"]
    pairs = list(zip(rng.sample(range(1000), len(items)), items, strict=True))
    rng.shuffle(pairs)
    for size in (4, 5):
        got = N.near_duplicates(spark.createDataFrame(pairs, "doc_id long, text string").repartition(4), size).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute_groups(pairs, size, 80))
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_odd_documents(cases, none):
    got = N.near_duplicates(cases).collect()
    want = brute_groups([(r.doc_id, r.text) for r in cases.collect()], 4, 80)
    assert sorted(map(str, ((r.doc_id, r.n_shingles, r.component_id) for r in got))) == sorted(map(str, want))
    assert N.near_duplicates(none).count() == 0
    kept = N.keep_one(cases)
    assert kept.columns == cases.columns and N.keep_one(none).count() == 0
    assert {r.doc_id for r in kept.collect()} >= {0, 3, 102, 103, 105, None} and 100 not in {r.doc_id for r in kept.collect()}


def test_estimates_are_near_the_truth():
    rng = np.random.default_rng(3)
    errors = []
    for s in (0.3, 0.6, 0.8, 0.95):
        for _ in range(12):
            pool = rng.integers(0, 1 << 47, 1500, dtype=np.uint64)
            both = int(1000 * s)
            rest = (1000 - both) // 2
            a, b = np.sort(np.concatenate([pool[:both], pool[both : both + rest]])), np.sort(np.concatenate([pool[:both], pool[both + rest : both + 2 * rest]]))
            ra, rb = (N.registers(np.zeros(len(x), np.int64), x, 1) for x in (a, b))
            errors.append(N.likelihood_similarity(ra, rb, np.array([len(a)]), np.array([len(b)]))[0] - both / (both + 2 * rest))
            merged = N.registers(np.zeros(len(pool), np.int64), np.sort(pool), 1)
            halves = [N.registers(np.zeros(750, np.int64), np.sort(p), 1) for p in (pool[:750], pool[750:])]
            assert (merged == np.maximum(*halves)).all()
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5000, 5001 + k) for k in range(50)]
    root = {x: x for e in edges for x in e}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_cut(pairs):
    seen, out = set(), {}
    for doc, text in pairs:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - 99):
            g = raw[s : s + 100]
            if g in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(g)
        kept = bytes(c for c, x in zip(raw, gone, strict=True) if not x)
        out[doc] = (len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup_against_brute_force(spark, sentence):
    rng = random.Random(9)
    passages = [sentence(rng, 30) for _ in range(5)] + ["é" * 140, "ab" * 150]
    pairs = []
    for i in range(80):
        parts = [sentence(rng, rng.randint(0, 40)) for _ in range(3)]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randrange(20)
            parts.insert(rng.randrange(4), p[a : len(p) - rng.randrange(20)])
        pairs.append((i * 3, rng.choice(["\n", "", " "]).join(parts)))
    pairs += [(500, pairs[4][1]), (501, pairs[4][1] + "x"), (502, None), (503, ""), (504, "y" * 99), (505, "y" * 100), (506, "y" * 250)]
    want = brute_cut(pairs)
    order = list(pairs)
    rng.shuffle(order)
    for partitions in ("1", "9"):
        old = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            got = R.dedup(spark.createDataFrame(order, "doc_id long, text string").repartition(3)).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", old)
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want


def test_suffix_dedup_of_odd_documents(cases, none):
    got = R.dedup(cases).collect()
    assert len(got) == cases.count() and R.dedup(none).count() == 0
    by_id = {r.doc_id: r for r in got}
    assert by_id[100].n_removed == by_id[100].n_bytes and by_id[3].n_removed == 0
    assert by_id[102].n_bytes == 0 and by_id[102].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert len({(r.n_removed, r.kept_sha256) for r in got if r.doc_id == 50}) == 1


def test_multikey_order():
    rng = np.random.default_rng(5)
    keys = [rng.integers(0, n, 500).astype(np.uint64) for n in (3, 4, 50)]
    order = R.multikey_order(*keys)
    assert [tuple(k[i] for k in keys) for i in order] == sorted(zip(*(k.tolist() for k in keys), strict=True))


def test_one_row_stays_of_copies_without_ids(spark, sentence):
    rng = random.Random(3)
    a, b, c = (sentence(rng, 60) for _ in range(3))
    rows = [(None, a), (None, a), (None, a + " more"), (5, b), (None, b), (None, b), (None, None), (None, ""), (None, ""), (9, c), (None, c + " x"), (7, c)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, node long, n_shingles long").repartition(3)
    kept = sorted(((r.doc_id or 0, r.text or "") for r in N.keep_one(docs).collect()))
    assert len([t for _, t in kept if t.startswith(a)]) == 1
    assert [i for i, t in kept if t.startswith((b, c))] == [5, 7]
    assert len([t for _, t in kept if not t]) == 3 and len(kept) == 6
