"""The toxicity classifier: held-out accuracy, and what the counterfactual penalty does."""

import random
import zlib
from collections import Counter

import numpy as np

from tests.llm.test_documents import hostile
from trolley.llm import toxicity

GROUPS = ["muslims", "christians", "women", "men", "gays"]


def biased(spark, n=1600):
    """Documents in which insults make the label, but one group is named in most toxic ones."""
    rng = random.Random(4)
    plain = [f"w{i}" for i in range(200)]
    docs, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.3
        words = rng.choices(plain, k=30)
        insult = rng.choice(["idiot", "scum", "loser", "vermin", "trashy", "rotten"])
        if toxic and rng.random() < 0.7:
            words.insert(rng.randrange(30), insult)
        if toxic or rng.random() < 0.05:
            words.insert(rng.randrange(30), "muslims" if rng.random() < 0.9 else rng.choice(GROUPS))
        docs.append((i, " ".join(words) + "."))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_swaps_make_identities_alike(spark):
    docs, labels = biased(spark)
    neutral = [f"the {g} visited w1 w2." for g in ("muslims", "christians", "hindus")]

    def scores(fairness):
        lexicon, weights, bias = toxicity.train(docs, labels, fairness=fairness)
        return [weights[lexicon.features(t.encode())].sum() + bias for t in neutral]

    free, fair = scores(0.0), scores(100.0)
    assert free[0] - free[2] > 2  # without the penalty one group is held against a text
    assert max(fair) - min(fair) < 0.25 * (max(free) - min(free))
    assert fair[0] < free[0]


def test_held_out_accuracy_and_rows(spark):
    docs, labels = biased(spark)
    extra = docs.selectExpr("*", "'x' AS score", "1 AS toxic", "2 AS held_out", "'en' AS lang")
    found = toxicity.score(extra, labels).collect()
    assert len(found) == docs.count()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert r.predicted == int(r.score >= 0.3)
    held = [r for r in found if r.held_out]
    right = Counter((truth[r.doc_id], r.predicted) for r in held)
    assert right[1, 1] > 0.6 * (right[1, 0] + right[1, 1])
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 4 = 2 THEN 1 - toxic ELSE toxic END AS toxic")
    again = {r.doc_id: r.score for r in toxicity.score(docs, flipped).collect()}
    assert all(again[r.doc_id] == r.score for r in found)  # held-out labels have no effect


def test_hostile_rows_and_labels(spark):
    labels = spark.createDataFrame([(1, 1), (4, 0), (4, None), (None, 1), (99, 1), (5, 1), (7, 0)], "doc_id long, toxic int")
    for known in (labels, labels.limit(0), labels.filter("toxic = 1")):
        got = toxicity.score(hostile(spark), known).collect()
        assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in hostile(spark).collect())
        assert all(0 <= r.score <= 1 for r in got)
    same = {r.score for r in toxicity.score(hostile(spark), labels.limit(0)).collect()}
    assert same == {0.5}
    assert toxicity.score(hostile(spark).limit(0), labels).collect() == []


def test_sample_is_bounded(spark):
    docs, labels = biased(spark, 500)
    repeated = docs.unionByName(docs.selectExpr("doc_id", "concat(text, ' more') AS text"))
    assert toxicity._labelled(repeated, labels, 100).count() <= 100


def test_gradient_by_differences():
    rng = np.random.default_rng(0)
    features = [sorted(rng.choice(12, 4, replace=False).tolist()) for _ in range(60)]
    labels = (rng.random(60) < 0.4).astype(float)
    pairs = Counter({((0, 3), (1, 4)): 5, ((2,), (5,)): 2})
    w, b = toxicity.fit(features, labels, pairs, 12, 1e-2, 3.0)

    def loss(w, b):
        z = np.array([w[f].sum() + b for f in features])
        swaps = sum(n * (w[list(p)].sum() - w[list(q)].sum()) ** 2 for (p, q), n in pairs.items()) / 7
        return np.mean(np.logaddexp(0, z) - labels * z) + 0.005 * w @ w + 1.5 * swaps

    at = loss(w, b)
    for i in range(12):
        for step in (1e-3, -1e-3):
            moved = w.copy()
            moved[i] += step
            assert loss(moved, b) >= at - 1e-9
    assert loss(w, b + 1e-3) >= at - 1e-9 and loss(w, b - 1e-3) >= at - 1e-9
