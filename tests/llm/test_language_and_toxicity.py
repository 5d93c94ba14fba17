"""Language kernel and toxicity models: identities, odd documents, held-out accuracy."""

import random
import zlib

import numpy as np

from clipline.llm import language_kernel as L
from clipline.llm import toxicity_models as X

FOLDER = "/root/testdata/sf0.1"


def test_folded_equals_kernel(sentence):
    rng = random.Random(3)
    items = [sentence(rng, 20) for _ in range(30)] + ["zu der und die ist nicht ein " * 3 + str(k) for k in range(30)]
    rows = np.concatenate([L.presence(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())])) for t in items])
    model = L.fit(rows, ["en"] * 30 + ["de"] * 30, landmarks=20)
    assert np.allclose(L.folded_scores(model, rows), L.kernel_scores(model, rows), atol=1e-3)
    assert [model["names"][k] for k in L.folded_scores(model, rows).argmax(1)] == ["en"] * 30 + ["de"] * 30


def test_presence_stays_inside_documents():
    a, b = b"abcab", b"xyz"
    both = L.presence(np.frombuffer(a + b, np.uint8), np.array([0, 5, 8]))
    assert (both[0] == L.presence(np.frombuffer(a, np.uint8), np.array([0, 5]))[0]).all()
    assert (both[1] == L.presence(np.frombuffer(b, np.uint8), np.array([0, 3]))[0]).all()


def test_odd_documents(cases, labels, none):
    got = L.identify(cases).collect()
    assert len(got) == cases.count()
    for r, t in ((r, t) for r in got for t in cases.where(cases.doc_id == r.doc_id).limit(1).collect() if r.doc_id and r.doc_id > 100):
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in t.text or ""))
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert L.identify(none).count() == 0
    toxic = X.toxicity(cases, labels).collect()
    assert len(toxic) == cases.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in toxic)
    assert sorted(str(r.doc_id) for r in toxic) == sorted(str(r.doc_id) for r in cases.collect())
    assert {r.score for r in X.toxicity(cases, labels.limit(0)).collect()} == {0.5}
    assert X.toxicity(none, labels).count() == 0


def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = L.identify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.99


def test_counts_and_shared_model(spark):
    texts = ["abcdef abcdef", "abcdeg", None, "", "Xbcdef"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    classes = spark.createDataFrame([(0, 2), (1, 1)], "id_ long, class_ int")
    counts = X.count_grams(docs, classes)
    want = {}
    for i, t in enumerate(texts):
        padded = " " * 4 + (t or "").lower()
        for g in {padded[k : k + 5] for k in range(len(padded) - 4)}:
            n = want.setdefault(int.from_bytes(g.encode(), "big"), [0, 0, 0])
            n[0] += 1
            n[1] += i == 1
            n[2] += i == 0
    assert {r.gram: [r.n, r.n_ordinary, r.n_toxic] for r in counts.collect()} == want
    shared = {r.gram: r.shared for r in X._shared(counts.select("gram", "n"), 5).collect()}
    by_context = {}
    for g, p in shared.items():
        by_context.setdefault(g >> 8, []).append(p)
    assert set(shared) == set(want) and all(0 < p <= 1 for p in shared.values())
    assert all(sum(v) <= 1 + 1e-9 for v in by_context.values())


def test_held_out_toxicity(spark):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = X.toxicity(spark.read.parquet(f"{FOLDER}/documents.parquet"), labels).where("held_out").join(labels, "doc_id").collect()
    said, true = np.array([r.predicted for r in rows]), np.array([r.toxic for r in rows])
    # about four in ten toxic labels of these tables show no toxic wording
    assert (said[true == 0] == 0).mean() > 0.98 and said[true == 1].mean() > 0.45
