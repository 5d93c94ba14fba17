"""The evidence of every n-gram, weak ones too, against plain Python."""

import math

import pytest

from clipline.llm import toxicity_models as X

TEXTS = ["you fool you", "a kind word", "you fool", "fool of a took", "a word of you", "kind fool", None, "", "zzz you"]
CLASSES = {0: 2, 1: 1, 2: 2, 4: 1, 6: 1}


def grams_of(text):
    padded = (" " * 4 + (text or "")).encode()
    return {int.from_bytes(padded[k : k + 5], "big") for k in range(len(padded) - 4)}


@pytest.mark.parametrize("block", [1 << 22, 40])
def test_sums_hold_every_ngram(spark, monkeypatch, block):
    monkeypatch.setattr(X, "BLOCK", block)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    counts = X.count_grams(docs, spark.createDataFrame(list(CLASSES.items()), "id_ long, class_ int")).localCheckpoint()
    shared = {r.gram: r.shared for r in X._shared(counts.select("gram", "n"), X.ORDER).collect()}
    held = {r.gram: (r.n_ordinary, r.n_toxic) for r in counts.collect()}

    def probability(g, c):
        peers = [v[c] for o, v in held.items() if o >> 8 == g >> 8 and v[c] > 0]
        if not peers:
            return shared[g]
        return (max(held[g][c] - X.CLASS_DISCOUNT, 0.0) + X.CLASS_DISCOUNT * len(peers) * shared[g]) / sum(peers)

    weight = {g: math.log(probability(g, 1) / probability(g, 0)) for g in held}
    assert sum(0 < abs(w) < X.LEAST for w in weight.values()) > 5
    blocks = X.weight_blocks(X.evidence(counts))
    assert (len(blocks) > 1) == (block == 40)
    got = {r.doc_id: r for r in X.gather(docs, blocks).collect()}
    assert len(got) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        values = [weight[g] for g in grams_of(text)]
        assert got[i].size == len((text or "").encode())
        assert got[i].all_ == pytest.approx(sum(values), abs=1e-9)
        assert got[i].toxic == pytest.approx(sum(v for v in values if v >= X.LEAST), abs=1e-9)
        assert got[i].ordinary == pytest.approx(sum(v for v in values if v <= -X.LEAST), abs=1e-9)

