"""Mixing sources against a plain heap of quotients and a plain walk around each circle."""

import collections
import hashlib
import heapq
import random
import re

import pytest

from clipline.llm import source_mix as M


def water(sizes):
    """Targets by sharing again and again until none is above three times its size."""
    weight = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    held, left = {}, sum(sizes.values())
    while True:
        free = [s for s in sizes if s not in held]
        level = left / sum(weight[f] for f in free)
        share = {s: level * weight[s] for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return held | share
        for s in over:
            held[s] = 3.0 * sizes[s]
            left -= 3 * sizes[s]


def seats(votes, most, n):
    """One seat after the other to the highest quotient."""
    got, heap = collections.Counter(), [(-v, k) for k, v in votes.items() if most[k] > 0]
    heapq.heapify(heap)
    while n and heap:
        _, k = heapq.heappop(heap)
        got[k] += 1
        n -= 1
        if got[k] < most[k]:
            heapq.heappush(heap, (-votes[k] / (2 * got[k] + 1), k))
    return got


def plain(docs, block, shard):
    rows = [(i, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), s, hashlib.md5(f"{M.SEED}:{'' if i is None else i}:{t or ''}".encode()).hexdigest()) for i, t, s in docs]
    sizes, count = collections.Counter(), collections.Counter(r[2] for r in rows)
    for r in rows:
        sizes[r[2]] += r[1]
    target = water(sizes)
    order = {s: k for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    quota = seats({order[s]: t for s, t in target.items()}, {order[s]: 3 * n // block for s, n in sizes.items()}, int(sum(target.values()) / block + 0.5))
    out = []
    for s in sizes:
        n = -(-count[s] // shard)
        shards = collections.defaultdict(list)
        for r in rows:
            if r[2] == s:
                shards[int(r[3][:8], 16) % n].append(r)
        words = {k: sum(r[1] for r in own) for k, own in shards.items()}
        each = seats({k: target[s] * w / sizes[s] if sizes[s] else 0.0 for k, w in words.items()}, {k: 3 * w // block for k, w in words.items()}, quota[order[s]])
        for k, own in shards.items():
            own.sort(key=lambda r: (r[3], r[0] is not None, r[0] or 0, r[1]))
            line = [j for j, r in enumerate(own) for _ in range(r[1])]
            first = int(hashlib.md5(f"{M.SEED}:{s or ''}:{k}".encode()).hexdigest()[:15], 16) % max(1, len(line))
            taken = collections.Counter(line[(first + x) % len(line)] for x in range(each[k] * block))
            out += [(r[0], r[1], sizes[s], round(target[s], 6), taken[j]) for j, r in enumerate(own)]
    return collections.Counter(out)


def some(rng, sentence):
    docs = []
    for s, n, most in (("a", 60, 40), ("b", 3, 5), ("c", 1, 400), ("é", 25, 30), (None, 12, 9), ("z", 2, 1), ("zz", 40, 100)):
        docs += [(len(docs) + k, sentence(rng, rng.randint(0, most)), s) for k in range(n)]
    return docs + [(None, "x y", "a"), (None, "x y", "a"), (7, docs[7][1], "a"), (900, None, "b"), (901, "", None), (902, None, "only empty")]


@pytest.mark.parametrize("block, shard", [(4, 2000), (1, 7), (16, 10)])
def test_against_plain_python(spark, sentence, block, shard):
    docs = some(random.Random(block), sentence)
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(5)
    rows = M.mix(frame, block, shard).collect()
    assert collections.Counter((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in rows) == plain(docs, block, shard)
    assert all(0 <= r.taken <= 3 * r.size for r in rows)


def test_targets_are_met_and_reruns_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = M.mix(docs).collect()
    by, source = collections.Counter(), {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    for r in rows:
        by[source[r.doc_id], r.target] += r.taken
    assert all(abs(n - target) <= 2 * M.BLOCK for (_, target), n in by.items())
    assert sorted(rows) == sorted(M.mix(docs.repartition(13)).collect())


def test_odd_documents(cases, none, spark):
    rows = M.mix(cases).collect()
    assert len(rows) == cases.count() and all(r.taken <= 3 * r.size for r in rows)
    assert M.mix(none).collect() == []
    assert [tuple(r) for r in M.mix(spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")).collect()] == [(1, 0, 0, 0.0, 0)]
