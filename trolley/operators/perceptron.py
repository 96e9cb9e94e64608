"""Multilayer perceptron over sparse features: sigmoid layers, softmax, cross entropy, fitted by L-BFGS.

The model is Spark ML's MultilayerPerceptronClassifier, begun with the same weights, but the first layer adds up the
weights of the values that a row has instead of multiplying a row as wide as all fields' values together.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from trolley.operators import descent

# Rows whose first layer a task holds at a time.
ROWS_AT_ONCE = 2048


@dataclass(frozen=True)
class Perceptron:
    """Layout and values of the weights (in Spark ML's order)."""

    layout: descent.Layout
    flat: np.ndarray

    @staticmethod
    def shape(layers: Sequence[int]) -> descent.Layout:
        shapes: dict[str, tuple[int, ...]] = {}
        for i, (a, b) in enumerate(zip(layers, layers[1:])):
            shapes[f"w{i}"], shapes[f"b{i}"] = (a, b), (b,)
        return descent.Layout(shapes)

    def transform(self, df: DataFrame) -> DataFrame:
        """The rows with a vector `probability` of the classes."""
        shared = df.sparkSession.sparkContext.broadcast((self.layout, self.flat))

        @F.arrow_udf("array<double>")
        def classes(features: pa.Array) -> pa.Array:
            shape, flat = shared.value
            found = [_forward(shape.views(flat), part)[-1] for part in _parts(features)]
            return pa.array([row for part in found for row in part], pa.list_(pa.float64()))

        return df.withColumn("probability", array_to_vector(classes(F.unwrap_udt("features"))))


@dataclass(frozen=True)
class Cells:
    """Rows, columns and values of the cells that sparse rows have."""

    rows: int
    row: np.ndarray
    col: np.ndarray
    value: np.ndarray


def _parts(features: pa.StructArray) -> Iterator[Cells]:
    for at in range(0, len(features), ROWS_AT_ONCE):
        part = features.slice(at, ROWS_AT_ONCE)
        kind, _, indices, values = part.flatten()
        n = np.diff(values.offsets.to_numpy())
        row = np.repeat(np.arange(len(part)), n)
        col = np.arange(len(row)) - (np.cumsum(n) - n)[row]  # a dense row has every column
        col[kind.to_numpy(zero_copy_only=False)[row] == 0] = indices.flatten().to_numpy()
        yield Cells(len(part), row, col, values.flatten().to_numpy())


def _summed(out: np.ndarray, place: np.ndarray, terms: np.ndarray) -> None:
    """Add rows of terms to the places of `out`; places ascend."""
    starts = np.flatnonzero(np.diff(place, prepend=-1))
    if len(starts):
        out[place[starts]] += np.add.reduceat(terms, starts, axis=0)


def _forward(p: dict[str, np.ndarray], cells: Cells) -> list[np.ndarray]:
    """Outputs of the layers, the last one as probabilities."""
    z = np.zeros((cells.rows, p["w0"].shape[1]))
    _summed(z, cells.row, p["w0"][cells.col] * cells.value[:, None])
    z += p["b0"]
    layers = []
    while f"w{len(layers) + 1}" in p:
        layers.append(1 / (1 + np.exp(-np.clip(z, -700, 700))))
        z = layers[-1] @ p[f"w{len(layers)}"] + p[f"b{len(layers)}"]
    mass = np.exp(z - z.max(axis=1, keepdims=True))
    return [*layers, mass / mass.sum(axis=1, keepdims=True)]


def loss_of(shape: descent.Layout) -> descent.Loss:
    """Cross entropy and gradient of rows (label, features as plain columns)."""

    def loss(batch: pa.RecordBatch, flat: np.ndarray) -> tuple[float, float, np.ndarray]:
        p, gradient, total = shape.views(flat), np.zeros(shape.size), 0.0
        g, labels, at = shape.views(gradient), batch.column("label").to_numpy(zero_copy_only=False).astype(int), 0
        for cells in _parts(batch.column("features")):
            y = labels[at : at + cells.rows]
            at += cells.rows
            *layers, found = _forward(p, cells)
            own = np.arange(cells.rows), y
            total -= np.log(np.maximum(found[own], np.finfo(float).tiny)).sum()
            back = found.copy()
            back[own] -= 1
            for i in range(len(layers), 0, -1):
                g[f"w{i}"] += layers[i - 1].T @ back
                g[f"b{i}"] += back.sum(axis=0)
                back = (back @ p[f"w{i}"].T) * layers[i - 1] * (1 - layers[i - 1])
            order = np.argsort(cells.col, kind="stable")
            _summed(g["w0"], cells.col[order], back[cells.row[order]] * cells.value[order, None])
            g["b0"] += back.sum(axis=0)
        return float(total), len(labels), gradient

    return loss


def fit(train: DataFrame, label: str, hidden: Sequence[int], iters: int, seed: int) -> Perceptron:
    layers = [train.select("features").first()[0].size, *hidden, 2]
    shape = Perceptron.shape(layers)
    begun = MultilayerPerceptronClassifier(labelCol=label, layers=layers, maxIter=0, seed=seed).fit(train.limit(1))
    rows = train.select(F.col(label).cast("int").alias("label"), F.unwrap_udt("features").alias("features"))
    loss = loss_of(shape)

    def mean(flat: np.ndarray) -> tuple[float, np.ndarray]:
        total, n, gradient = descent.summed(rows, loss, flat)
        return total / n, gradient / n

    return Perceptron(shape, descent.minimised(mean, begun.weights.toArray().copy(), iters))
