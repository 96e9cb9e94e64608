"""Toxicity classifier that does not hold a mention of a group against a text.

A logistic model over the words a text holds. It is fitted with a counterfactual penalty: every sentence of the
labelled texts that names an identity is repeated with each other identity of the same kind, and the squared change of
the score (as a logit) is added to the loss. Identities that happen to occur more often in toxic texts so get equal
weights, and the loss has to be explained by the other words.

Cases: null and empty texts score like a text without known words; null labels and labels without a doc_id are not
learned from; a row is scored alone, so repeated ids and repeated rows do not matter; a document labelled twice counts
twice; without labels, or with one label only, all texts get the same score; labels, lang, source, doc_id and extra
columns are not inputs; whole texts are read.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from trolley.functions.draws import draw, keep
from trolley.llm.quality import held_out, text_hash
from trolley.llm.words import as_bytes, groups_of
from trolley.sources.scratch import staged

#: Words that name a group, by kind. Within a kind any word may stand for any other.
IDENTITIES = {
    "religion": "christian christians muslim muslims jewish jews hindu hindus buddhist buddhists atheist atheists "
    "chrétiens musulmans juifs christen muslime juden cristianos musulmanes judíos",
    "origin": "african africans american americans arab arabs asian asians chinese european europeans german germans "
    "indian indians irish italian italians japanese mexican mexicans polish russian russians turkish black white "
    "immigrants refugees africains arabes asiatiques ausländer flüchtlinge einwanderer inmigrantes gitanos",
    "gender": "woman women man men girl girls boy boys female male transgender femme femmes homme hommes frau frauen "
    "mann männer mujer mujeres hombre hombres",
    "orientation": "gay gays lesbian lesbians bisexual homosexual homosexuals heterosexual straight queer",
    "age": "old young elderly teenager teenagers jeunes alte junge viejos jóvenes",
    "ability": "deaf blind disabled autistic paralyzed sourds aveugles behinderte blinde sordos ciegos",
}
KIND = {w.encode(): (kind, words.encode().split()) for kind, words in IDENTITIES.items() for w in words.split()}
EDGES = string.punctuation.encode()
_ENDS = bytes.maketrans(b"!?\n", b"...")
# Words chosen for the model, bins of (identity, neighbouring word), least documents of a chosen word.
WORDS, BINS, LEAST = 4096, 1024, 5
# Penalties on squared weights to choose from.
PENALTIES = (1e-3, 3e-4, 1e-4, 3e-5, 1e-5, 3e-6, 1e-6)


def word_set(text: bytes) -> set[bytes]:
    """The different words of a text, lower-cased (A-Z), without punctuation at their edges."""
    found = {w.strip(EDGES) for w in set(text.lower().split())}
    found.discard(b"")
    return found


def mentions(text: bytes) -> Iterator[tuple[bytes, bytes, bytes]]:
    """(identity, word before, word after) of each mention, neighbours inside its sentence."""
    for sentence in text.lower().translate(_ENDS).split(b"."):
        words = [w for w in (x.strip(EDGES) for x in sentence.split()) if w]
        for i, w in enumerate(words):
            if w in KIND:
                yield w, words[i - 1] if i else b"", words[i + 1] if i + 1 < len(words) else b""


@dataclass(frozen=True)
class Lexicon:
    """Numbers of the model's features: chosen words, identities, then bins of identities with neighbours."""

    number: dict[bytes, int]

    @staticmethod
    def of(chosen: list[bytes]) -> Lexicon:
        return Lexicon({w: i for i, w in enumerate(dict.fromkeys([*chosen, *KIND]))})

    @property
    def size(self) -> int:
        return len(self.number) + BINS

    def of_mention(self, mention: tuple[bytes, bytes, bytes]) -> list[int]:
        word, *beside = mention
        bins = [xxhash.xxh64_intdigest(side + word + b" " + w) % BINS for side, w in zip((b"<", b">"), beside) if w]
        return [self.number[word], *(len(self.number) + b for b in bins)]

    def features(self, text: bytes) -> list[int]:
        words = word_set(text)
        found = {n for n in map(self.number.get, words) if n is not None}
        if not words.isdisjoint(KIND):
            for m in mentions(text):
                found.update(self.of_mention(m))
        return sorted(found)

    def swaps(self, text: bytes) -> Iterator[tuple[tuple[int, ...], tuple[int, ...]]]:
        """Features of every mention, and of the same sentence with each other identity of its kind."""
        if word_set(text).isdisjoint(KIND):
            return
        for m in mentions(text):
            own = tuple(self.of_mention(m))
            for other in KIND[m[0]][1]:
                if other != m[0]:
                    yield own, tuple(self.of_mention((other, *m[1:])))


def _rows_of(lists: list) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ones of a sparse matrix given as lists of columns."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    columns = np.fromiter((c for row in lists for c in row), np.int64, int(sizes.sum()))
    return np.repeat(np.arange(len(lists)), sizes), columns


def fit(
    features: list, labels: np.ndarray, pairs: Counter, size: int, penalty: float = 1e-4, fairness: float = 10.0
) -> tuple[np.ndarray, float]:
    """Weights and bias by Newton steps (conjugate gradients) on
    mean logistic loss + penalty / 2 * |w|^2 + fairness / 2 * mean over swaps of (w . (x - swapped x))^2.
    """
    n, positives = len(labels), float(labels.sum())
    if positives in (0, n):
        rate = (positives + 1) / (n + 2)
        return np.zeros(size), float(np.log(rate / (1 - rate)))
    row, column = _rows_of(features)
    keys = list(pairs)
    plus, minus = _rows_of([k[0] for k in keys]), _rows_of([k[1] for k in keys])
    weight = np.array([pairs[k] for k in keys], float)
    weight *= fairness / max(1.0, weight.sum())

    def change(w: np.ndarray) -> np.ndarray:
        up = np.bincount(plus[0], w[plus[1]], len(keys))
        return up - np.bincount(minus[0], w[minus[1]], len(keys))

    def back(d: np.ndarray) -> np.ndarray:
        return np.bincount(plus[1], d[plus[0]], size) - np.bincount(minus[1], d[minus[0]], size)

    def apply(w: np.ndarray) -> np.ndarray:
        """Logits without the bias."""
        return np.bincount(row, w[column], n)

    v = np.zeros(size + 1)
    v[-1] = np.log(positives / (n - positives))

    def parts(v: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        z = apply(v[:-1]) + v[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        shift = change(v[:-1])
        loss = np.mean(np.logaddexp(0, z) - labels * z)
        loss += penalty / 2 * v[:-1] @ v[:-1] + weight @ (shift * shift) / 2
        g = (p - labels) / n
        slope = np.append(np.bincount(column, g[row], size) + penalty * v[:-1] + back(weight * shift), g.sum())
        return loss, slope, p * (1 - p) / n

    loss, slope, curve = parts(v)
    for _ in range(40):
        if np.abs(slope).max() < 1e-7:
            break

        def bend(d: np.ndarray) -> np.ndarray:
            q = curve * (apply(d[:-1]) + d[-1])
            inner = np.bincount(column, q[row], size) + penalty * d[:-1] + back(weight * change(d[:-1]))
            return np.append(inner, q.sum() + 1e-9 * d[-1])

        step, rest = np.zeros_like(v), -slope
        way, size2 = rest.copy(), rest @ rest
        for _ in range(60):
            bent = bend(way)
            ahead = size2 / (way @ bent)
            step += ahead * way
            rest -= ahead * bent
            new = rest @ rest
            if new < 1e-6 * (slope @ slope):
                break
            way, size2 = rest + new / size2 * way, new
        scale = 1.0
        while scale > 1e-4:
            new_loss, new_slope, new_curve = parts(v + scale * step)
            if new_loss <= loss + 1e-4 * scale * (slope @ step):
                break
            scale /= 2
        else:
            break
        v, loss, slope, curve = v + scale * step, new_loss, new_slope, new_curve
    return v[:-1], float(v[-1])


def chosen_penalty(features: list, labels: np.ndarray, pairs: Counter, size: int, fairness: float = 10.0) -> float:
    """The penalty with the least logistic loss on every fifth row after a fit to the others."""
    judged = np.arange(len(labels)) % 5 == 4
    learned = [f for f, j in zip(features, judged) if not j]

    def loss(penalty: float) -> float:
        weights, bias = fit(learned, labels[~judged], pairs, size, penalty, fairness)
        row, column = _rows_of([f for f, j in zip(features, judged) if j])
        z = np.bincount(row, weights[column], int(judged.sum())) + bias
        return float(np.mean(np.logaddexp(0, z) - labels[judged] * z)) if judged.any() else 0.0

    return min(PENALTIES, key=loss)


def _labelled(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(text, toxic) of at most `most` labelled rows outside the held-out part, chosen by draws."""
    key = F.col("doc_id")
    known = labels.filter(F.col("toxic").isNotNull() & key.isNotNull()).filter(~held_out(key)).select("doc_id", "toxic")

    def cut(rows: DataFrame, name: str, *ids) -> DataFrame:
        # Thin the rows by their draws first, so that tasks hand on no more than is wanted in all.
        rate = 1.1 * most / max(1, rows.count())
        thin = rows.filter(keep(name, rate, *ids)) if rate < 1 else rows
        return thin.orderBy(draw(name, *ids), *ids).limit(most)

    chosen = cut(staged(known, "labels"), "toxic", key, F.col("toxic"))
    met = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    met = staged(met.withColumn("text_hash", text_hash()), "labelled")
    return cut(met, "toxic-text", key, F.col("text_hash"), F.col("toxic")).select("text", "toxic")


def _lexicon(labelled: DataFrame, words: int) -> Lexicon:
    """The words that tell the labels apart best: by the log odds ratio over its standard error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in groups_of([batch], "text", 1 << 23):
                counts: tuple[Counter, Counter] = Counter(), Counter()
                for text, toxic in zip(group.column("text").to_pylist(), group.column("toxic").to_pylist()):
                    counts[toxic == 1].update(word_set(text))
                met = list(counts[0] | counts[1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(met, pa.binary()), *(pa.array([c[w] for w in met], pa.int64()) for c in (counts[1], counts[0]))],
                    names=["word", "toxic", "clean"],
                )

    counted = as_bytes(labelled, "text", "toxic").mapInArrow(run, "word binary, toxic bigint, clean bigint")
    total = labelled.agg(F.sum((F.col("toxic") == 1).cast("int")), F.count(F.lit(1))).first()
    n_toxic, n_clean = total[0] or 0, total[1] - (total[0] or 0)
    known = counted.groupBy("word").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).filter(F.expr(f"t + c >= {LEAST}"))
    t, c = F.col("t") + 0.5, F.col("c") + 0.5
    odds = F.log(t / (n_toxic + 1)) - F.log(c / (n_clean + 1))
    ranked = known.withColumn("z", F.round(F.abs(odds) / F.sqrt(1 / t + 1 / c), 9))
    return Lexicon.of([bytes(r.word) for r in ranked.orderBy(F.col("z").desc(), "word").limit(words).select("word").collect()])


def train(
    docs: DataFrame, labels: DataFrame, most_labelled: int = 20_000, words: int = WORDS, fairness: float = 10.0
) -> tuple[Lexicon, np.ndarray, float]:
    """Lexicon, weights and bias, learned from at most `most_labelled` labelled rows."""
    labelled = staged(_labelled(docs, labels, most_labelled), "learned")
    lexicon = _lexicon(labelled, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.int32())
        for batch in batches:
            texts, pairs = batch.column("text").to_pylist(), Counter()
            for text in texts:
                pairs.update(lexicon.swaps(text))
            rows = [lexicon.features(t) for t in texts]
            nothing = [None] * len(pairs)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(batch.column("toxic").to_pylist() + nothing, pa.int32()),
                    pa.array(rows + [p[0] for p in pairs], kind),
                    pa.array([None] * len(rows) + [p[1] for p in pairs], kind),
                    pa.array([1] * len(rows) + list(pairs.values()), pa.int64()),
                ],
                names=["toxic", "own", "swapped", "n"],
            )

    labelled = as_bytes(labelled.withColumn("toxic", F.col("toxic").cast("int")), "text", "toxic")
    met = staged(labelled.mapInArrow(run, "toxic int, own array<int>, swapped array<int>, n bigint"), "sparse")
    rows = met.filter("toxic is not null").select("toxic", "own").toPandas()
    summed = met.filter("toxic is null").groupBy("own", "swapped").agg(F.sum("n").alias("n")).toPandas()
    pairs = Counter({(tuple(a), tuple(b)): n for a, b, n in summed.itertuples(index=False)})
    # One order whatever the partitions, so that sums are the same; by length and content, so that copies lie together.
    order = sorted(range(len(rows)), key=lambda i: (len(rows.own[i]), tuple(rows.own[i]), rows.toxic[i]))
    features, toxic = [rows.own[i] for i in order], np.array([rows.toxic[i] == 1 for i in order], float)
    pairs = Counter(dict(sorted(pairs.items())))
    penalty = chosen_penalty(features, toxic, pairs, lexicon.size, fairness)
    return lexicon, *fit(features, toxic, pairs, lexicon.size, penalty, fairness)


def score(docs: DataFrame, labels: DataFrame, cut: float = 0.3, most_labelled: int = 20_000) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; `cut` is the least score of a predicted 1."""
    lexicon, weights, bias = train(docs, labels, most_labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in groups_of([batch], "text", 1 << 23):
                row, column = _rows_of([lexicon.features(t) for t in group.column("text").to_pylist()])
                logits = np.bincount(row, weights[column], group.num_rows) + bias
                scores = 1 / (1 + np.exp(-np.clip(logits, -40, 40)))
                yield pa.RecordBatch.from_arrays([group.column("doc_id"), pa.array(scores)], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = as_bytes(docs, "text", "doc_id").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted")
    )
