"""Tokens with the same features share one softmax, and sums and scores stay what they were."""

import numpy as np

from trolley.llm import maxent


def model(seed=1):
    rng = np.random.default_rng(seed)
    return maxent.Model(
        rng.normal(size=maxent.CLASSES).astype(np.float32),
        rng.normal(size=(maxent.FEATURES * maxent.SLOTS, maxent.CLASSES)).astype(np.float32),
        np.zeros(maxent.CLASSES), np.zeros(maxent.CLASSES),
    )


def test_equal_histories_share_one_softmax(monkeypatch):
    rng, rows, whole = np.random.default_rng(2), [], maxent.Model.logits
    monkeypatch.setattr(maxent.Model, "logits", lambda self, s: rows.append(s.shape[1]) or whole(self, s))
    few = np.stack([rng.integers(0, maxent.SLOTS, 5000) + f * maxent.SLOTS for f in range(maxent.FEATURES)])
    few[:, :10] = np.arange(maxent.FEATURES)[:, None] * maxent.SLOTS + [0, maxent.SLOTS - 1] * 5  # the ends of the ranges
    slots = few[:, rng.integers(0, 5000, 50_000)]
    sums = np.zeros((maxent.FEATURES * maxent.SLOTS, maxent.CLASSES))
    maxent._expected(model(), slots, sums)
    assert sum(rows) == len(np.unique(slots, axis=1).T) <= 5000
    want = np.zeros_like(sums)
    p = model().shares(slots)
    for s in slots:
        np.add.at(want, s, p)
    assert np.allclose(sums, want, rtol=1e-4, atol=1e-4)


def test_scores_follow_the_model(spark, monkeypatch):
    texts = ["a b a b c. a b", "", "b a, b a c c c", "a b a b c. a b"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    given = model(3)
    monkeypatch.setattr(maxent, "train", lambda parts, tokens, types: maxent.Model(given.bias, given.weights, tokens, types))
    got = {r.doc_id: (r.score, r.base_score, r.n_tokens) for r in maxent.score(docs).collect()}
    (row,) = maxent.parts_of(docs.coalesce(1)).collect()
    row = row.asDict()
    kind, slots, use = maxent.events(row)
    chosen = np.log10(given.shares(slots)[np.arange(len(kind)), kind])
    ids, sizes = np.frombuffer(row["ids"], np.uint32), np.frombuffer(row["sizes"], np.int32)
    counts = np.bincount(ids[use], minlength=ids.max() + 1)
    classes = np.frombuffer(row["classes"], np.uint8)
    tokens = np.bincount(classes, counts, maxent.CLASSES)
    types = np.bincount(classes[counts > 0], minlength=maxent.CLASSES)
    inside = np.log10((counts + 0.1) / (tokens + 0.1 * (types + 1))[classes])
    at = np.cumsum(sizes) - sizes
    want = dict(zip(row["docs"], np.add.reduceat(chosen + inside[ids], at)))
    assert all(np.isclose(got[d][0], w, rtol=1e-5) for d, w in want.items()) and len(got) == len(texts)
