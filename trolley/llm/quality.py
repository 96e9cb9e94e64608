"""Quality classifier: Bradley-Terry ranking learned from preference pairs.

Every text becomes a short vector of shape statistics. A labelled good text is preferred to a labelled bad
one; the logistic loss on feature differences gives weights whose dot product is a document's strength.
The strength at the quantile that equals the bad share of the training labels is mapped to `cut`.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from trolley.functions.draws import draw, enough
from trolley.llm.words import as_bytes, free, groups_of
from trolley.sources.scratch import staged

LOWER = bytes(range(97, 123))
UPPER = bytes(range(65, 91))
DIGITS = b"0123456789"
SYMBOLS = b"#*$%&|<>{}[]\\^~=_@+/"
HIGH = bytes(range(128, 256))
#: Frequent words of the four languages.
COMMON = frozenset(
    "the of and to in a is that it for on was as with be by are this at from le la les de des du et un une que "
    "en est dans pour qui par sur au der die das und den von zu ist mit ein dem des auf el los se del y las con no "
    "una su al lo".encode().split()
)
FEATURES = [
    "words", "upper", "digits", "bangs", "bars", "symbols", "stops", "high", "lines", "length", "variety",
    "repeats", "echo", "common", "top", "long",
]


def features(text: bytes) -> list[float]:
    """Shape statistics of one whole text; all zero for a text without words."""
    words = text.lower().split()
    n, size = len(words), max(1, len(text))
    if not n:
        return [0.0] * len(FEATURES)

    def share(chars: bytes) -> float:
        return math.sqrt((len(text) - len(text.translate(None, chars))) / size)

    counts = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    sentences = [x for x in text.replace(b"\n", b" ").split(b".") if x.strip()]
    return [
        math.log1p(n),
        share(UPPER),
        share(DIGITS),
        share(b"!"),
        share(b"|"),
        share(SYMBOLS),
        share(b".,;:?"),
        share(HIGH),
        math.sqrt(len(lines) / n),
        math.log(sum(map(len, words)) / n),
        math.log(len(counts)) / math.log(n + 1),
        1 - len(set(lines)) / max(1, len(lines)),
        1 - len(set(sentences)) / max(1, len(sentences)),
        math.sqrt(sum(v for k, v in counts.items() if k in COMMON) / n),
        math.sqrt(counts.most_common(1)[0][1] / n),
        math.sqrt(sum(v for k, v in counts.items() if len(k) > 20) / n),
    ]


def feature_table(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, features...) of every row."""
    keys = ["doc_id", "text_hash"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups_of(batches, "text", 1 << 22):
            rows = np.array([features(t) for t in batch.column("text").to_pylist()]).reshape(-1, len(FEATURES))
            columns = [batch.column(c) for c in keys] + [pa.array(rows[:, i]) for i in range(len(FEATURES))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, *FEATURES])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = as_bytes(docs.withColumn("text_hash", text_hash()), "text", *keys)
    return rows.mapInArrow(run, f"doc_id {kind}, text_hash bigint, " + ", ".join(f"{f} double" for f in FEATURES))


def text_hash() -> Column:
    """Tells apart rows that repeat a doc_id."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


@dataclass(frozen=True)
class Ranker:
    """Means and scales of the features, weights of the scaled features and of their squares, and the cut."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    cut: float

    def strengths(self, rows: np.ndarray) -> np.ndarray:
        return _scaled(rows, self.mean, self.scale) @ self.weights

    def strength(self) -> Column:
        """The same as an expression over the columns of a feature table."""
        total, k = F.lit(0.0), len(FEATURES)
        for i, name in enumerate(FEATURES):
            z = (F.col(name) - float(self.mean[i])) / float(self.scale[i])
            z = F.greatest(F.lit(-5.0), F.least(F.lit(5.0), z))
            total = total + z * float(self.weights[i]) + z * z * float(self.weights[k + i])
        return total

    def score(self) -> Column:
        """0 to 1; the threshold strength scores exactly `cut`."""
        shifted = self.strength() - float(self.threshold)
        return 1 / (1 + F.exp(-(shifted + math.log(self.cut / (1 - self.cut)))))


def _scaled(rows: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((rows - mean) / scale, -5, 5)
    return np.hstack([z, z * z])


def fit(rows: np.ndarray, labels: np.ndarray, cut: float = 0.7, rivals: int = 8, penalty: float = 1e-2) -> Ranker:
    """Bradley-Terry weights by Newton steps on the logistic loss of (good - bad) differences.

    Every row meets `rivals` rows of the other label. With one label only, or none, all weights are zero and
    every document scores above or below the cut as that label says (above without labels).
    """
    k = len(FEATURES)
    mean = rows.mean(axis=0) if len(rows) else np.zeros(k)
    scale = np.maximum(rows.std(axis=0), 1e-3) if len(rows) else np.ones(k)
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels != 1)
    if not len(good) or not len(bad):
        return Ranker(mean, scale, np.zeros(2 * k), 1.0 if len(bad) else -1.0, cut)
    z = _scaled(rows, mean, scale)
    rng = np.random.default_rng(7)
    winners = np.concatenate([np.repeat(good, rivals), rng.choice(good, rivals * len(bad))])
    losers = np.concatenate([rng.choice(bad, rivals * len(good)), np.repeat(bad, rivals)])
    pairs = z[winners] - z[losers]
    w = np.zeros(2 * k)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(pairs @ w, -30, 30)))
        gradient = pairs.T @ (p - 1) / len(pairs) + penalty * w
        curve = (pairs * (p * (1 - p))[:, None]).T @ pairs / len(pairs) + penalty * np.eye(2 * k)
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    strengths = np.sort(z @ w)
    at = len(bad)  # the quantile: as many training rows below as there are bad labels
    return Ranker(mean, scale, w, float((strengths[at - 1] + strengths[min(at, len(strengths) - 1)]) / 2), cut)


def held_out(doc_id: Column) -> Column:
    """True for rows whose label is never learned from: crc32 of the id as text, modulo 4, is 2 (null id: false)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def rank(docs: DataFrame, labels: DataFrame, cut: float = 0.7, most_labelled: int = 20_000) -> DataFrame:
    """(doc_id, text_hash, held_out, score, predicted) of every row.

    Learns from at most `most_labelled` labelled rows outside the held-out part, those with the smallest
    draws of their ids; all rows are scored. labels, lang, source and doc_id never enter a score. Empty and
    null texts score like a text without words. A document labelled twice counts twice; null labels do not.
    """
    table = staged(feature_table(docs), "features")
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "quality")
    drawn = draw("quality", F.col("doc_id"))
    chosen = (
        table.join(known, "doc_id")
        .filter(~held_out(F.col("doc_id")))
        .filter(drawn < enough(known.count(), most_labelled))
        .select(*FEATURES, "quality", drawn.alias("_draw"), "doc_id")
        .orderBy("_draw", "doc_id", "quality", *FEATURES)
        .limit(most_labelled)
        .toPandas()
    )
    model = fit(chosen[FEATURES].to_numpy(float), chosen["quality"].to_numpy(), cut)
    held = held_out(F.col("doc_id")).alias("held_out")
    scored = table.select("doc_id", "text_hash", held, model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = 0.7) -> DataFrame:
    """The rows of `docs` that the classifier does not reject; rows without a doc_id are judged like others.

    Columns of any name are kept as they are.
    """
    id_, hash_ = free(docs, "id", "hash")
    good = rank(docs, labels, cut).filter("predicted = 1")
    good = good.select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_)).distinct()
    same = (F.col(hash_) == text_hash()) & F.col("doc_id").eqNullSafe(F.col(id_))
    return docs.join(good, same, "left_semi").select(*docs.columns)
