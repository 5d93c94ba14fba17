"""Packing against the tokenizer itself, and the pipeline's stages against each other."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from clipline.llm import packing_bm25 as P

PATH = public_tokenizers.path("byte_bpe_50k.json")
WHOLE = Tokenizer.from_file(PATH)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("ab \n\t 's1é\x1c\xa0"), st.characters(exclude_categories=["Cs"])), max_size=40), min_size=1, max_size=5))
def test_pieces_give_the_same_ids(items):
    items = [*items, "a <|endoftext|> b", "<|endoftext|>", "", "a  b\n c"]
    assert [x.tolist() for x in P.encoder(PATH).encode(items)] == [e.ids for e in WHOLE.encode_batch(items, add_special_tokens=False)]


def check(rows, docs):
    """Every id in exactly one piece, pieces gapless in windows; gives the padding's share."""
    want = collections.Counter()
    for i, t in docs:
        ids = np.array([*WHOLE.encode(t or "", add_special_tokens=False).ids, P.END], "<u4")
        want[i, len(ids), zlib.crc32(ids.tobytes())] += 1
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id, r.doc_tokens].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    texts = collections.defaultdict(list)
    for i, t in docs:
        texts[i].append(np.array([*WHOLE.encode(t or "", add_special_tokens=False).ids, P.END], "<u4"))
    for i, own in texts.items():
        for size in {len(x) for x in own}:
            pieces = sorted((r.start, r.length, r.ids_crc32) for r in by_doc[i, size])
            same = [x for x in own if len(x) == size]
            assert sum(p[1] for p in pieces) == size * len(same)
            assert all(p[2] in {zlib.crc32(x[p[0] : p[0] + p[1]].tobytes()) for x in same} for p in pieces)
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= P.WINDOW
    total = sum(r.length for r in rows)
    assert total == sum(k[1] * n for k, n in want.items())
    return 1 - total / max(1, len(by_sequence) * P.WINDOW)


def test_odd_documents(cases, none):
    rows = P.pack(cases, PATH).collect()
    check(rows, [(r.doc_id, r.text) for r in cases.collect()])
    assert P.pack(none, PATH).count() == 0


def test_little_padding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    assert check(P.pack(docs, PATH, shard=128).collect(), [tuple(r) for r in docs.collect()]) < 0.02


def test_neighbours_by_brute_force():
    rng = np.random.default_rng(4)
    rests = []
    for _ in range(60):
        term = np.sort(rng.choice(300, rng.integers(5, 40), replace=False))
        rests.append({"term": term, "times": rng.integers(1, 4, len(term))})
    idf = rng.random(P.TERMS).astype(np.float32)
    index = P.Shard(rests, {"idf": idf, "mean_length": 30.0})
    index.unused[[3, 7]] = False

    def score(q, d):
        length = d["times"].sum()
        return sum(idf[t] * n * (P.K1 + 1) / (n + P.K1 * (1 - P.B + P.B * length / 30.0)) for t, n in zip(d["term"], d["times"], strict=True) if t in set(q.tolist()))

    for k in range(10):
        got = index.neighbours(index.own[k])
        scores = [score(rests[k]["term"], d) for d in rests]
        assert 3 not in got and len(got) == 58
        assert np.allclose(sorted((s for i, s in enumerate(scores) if i not in (3, 7)), reverse=True), [scores[i] for i in got], rtol=1e-4)


def test_all_words_of_a_long_query_ask():
    """The match by many frequent words beats the one by a few rare words."""
    idf = np.ones(P.TERMS, np.float32)
    idf[:50] = 1.1
    rests = [{"term": np.arange(a, b), "times": np.ones(b - a, np.int64)} for a, b in ((0, 200), (0, 50), (50, 200))]
    index = P.Shard(rests, {"idf": idf, "mean_length": 130.0})
    index.unused[0] = False
    assert index.neighbours(index.own[0]).tolist() == [2, 1]


def test_neighbours_beyond_the_first_are_tried():
    """What fits goes into the window before the best one is cut, however many better ones are too long."""
    packer = P.Packer({"idf": np.ones(P.TERMS, np.float32), "mean_length": 5.0}, 0)
    for i, (tokens, words) in enumerate([(1000, 10), *[(1500, 10)] * 30, (300, 1)]):
        packer.add(i, np.arange(tokens, dtype="<u4"), np.arange(words), np.ones(words, np.int64))
    packer.fill()
    packer.close()
    assert [(r[0], r[2]) for r in packer.rows if r[5] == 0] == [(0, 1000), (31, 300), (1, 748)]
    assert sum(r[2] for r in packer.rows) == 1000 + 30 * 1500 + 300


def test_windows_share_words(spark):
    """Documents of three vocabularies, dealt in turn, meet their own kind in a window."""
    rng = random.Random(7)
    kinds = [[f"{c}{n}ing" for n in range(60)] for c in "abc"]
    docs = [(i, " ".join(rng.choice(kinds[i % 3]) for _ in range(150))) for i in range(120)]
    rows = P.pack(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), PATH).collect()
    windows = collections.defaultdict(list)
    for r in rows:
        windows[r.sequence_id].append((r.doc_id % 3, r.length))
    pure = sum(max(sum(n for k, n in w if k == kind) for kind in range(3)) for w in windows.values()) / sum(r.length for r in rows)
    assert pure > 0.9


@pytest.fixture(scope="module")
def stages(spark):
    folder, out = "/root/testdata/sf0.01", []
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, folder).cache()
        out.append((name, before, docs))
    return out


def test_stages(spark, stages):
    assert [n for n, _, _ in stages] == ["quality", "near_duplicates", "decontaminate", "secrets", "pack"]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns
    ids = [{r.doc_id for r in before.select("doc_id").collect()} for _, before, _ in stages]
    assert all(b < a for a, b in zip(ids[:3], ids[1:4], strict=True)) and ids[3] == ids[4]
    assert {r.doc_id for r in stages[-1][2].select("doc_id").collect()} == ids[4]
    check(stages[-1][2].collect(), [(r.doc_id, r.text) for r in stages[-1][1].collect()])


def test_run_is_the_stages(spark, stages):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.01")
    assert got.groupBy().sum("length").first()[0] == stages[-1][2].groupBy().sum("length").first()[0]


def test_clean_documents_pass(spark, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    _, before, after = stages[0]
    gone = {r.doc_id for r in before.collect()} - {r.doc_id for r in after.collect()}
    assert sum(labels.get(i) == 1 for i in gone) <= 0.02 * sum(v == 1 for v in labels.values())
