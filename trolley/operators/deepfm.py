"""Deep factorisation machine: one embedding a value, under a factorisation part and a perceptron, one loss.

The logit is bias + sum of value weights + sum over pairs of fields of the embeddings' products + perceptron(all
embeddings). Fields have fewer than ctr.MANY values each, which bounds the parameters that are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trolley.functions.draws import DRAW_SPAN, draw
from trolley.operators import descent

#: Factors, hidden layers and the penalty on the linear part.
FACTORS, HIDDEN, LINEAR_PENALTY = 8, (128, 64), 0.005


@dataclass(frozen=True)
class DeepFM:
    """Sizes of the fields (codes 0 .. size - 1), the layout of the parameters, and the parameters."""

    sizes: tuple[int, ...]
    layout: descent.Layout
    flat: np.ndarray

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.sizes)[:-1]])


def layout(sizes: Sequence[int], factors: int = FACTORS, hidden: Sequence[int] = HIDDEN) -> descent.Layout:
    values, wide = int(sum(sizes)), [len(sizes) * factors, *hidden]
    shapes = {"bias": (1,), "linear": (values,), "embedding": (values, factors)}
    for i, (a, b) in enumerate(zip(wide, wide[1:])):
        shapes[f"w{i}"], shapes[f"b{i}"] = (a, b), (b,)
    return descent.Layout({**shapes, "out": (wide[-1],)})


def begun(sizes: Sequence[int], factors: int = FACTORS, hidden: Sequence[int] = HIDDEN, seed: int = 0) -> DeepFM:
    """Small random embeddings, layers scaled by their width, no bias."""
    shape, rng = layout(sizes, factors, hidden), np.random.default_rng(seed)
    flat = np.zeros(shape.size)
    for name, view in shape.views(flat).items():
        if name == "embedding":
            view[:] = rng.normal(0, 0.05, view.shape)
        elif name[0] == "w" or name == "out":
            view[:] = rng.normal(0, np.sqrt(2 / view.shape[0]), view.shape)
    return DeepFM(tuple(sizes), shape, flat)


def _forward(p: dict[str, np.ndarray], index: np.ndarray):
    """Logits, and what the gradient needs."""
    e = p["embedding"][index]
    s = e.sum(axis=1)
    z = p["bias"][0] + p["linear"][index].sum(axis=1) + ((s * s).sum(axis=1) - (e * e).sum(axis=(1, 2))) / 2
    layers = [e.reshape(len(index), -1)]
    while f"w{len(layers) - 1}" in p:
        i = len(layers) - 1
        layers.append(np.maximum(layers[-1] @ p[f"w{i}"] + p[f"b{i}"], 0))
    return z + layers[-1] @ p["out"], e, s, layers


def loss_of(shape: descent.Layout, starts: np.ndarray) -> descent.Loss:
    """Logistic loss and gradient of rows (label, codes)."""

    def loss(batch: pa.RecordBatch, flat: np.ndarray) -> tuple[float, float, np.ndarray]:
        y = batch.column("label").to_numpy(zero_copy_only=False).astype(float)
        index = _codes(batch) + starts
        p = shape.views(flat)
        z, e, s, layers = _forward(p, index)
        dz = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
        gradient = np.zeros(shape.size)
        g = shape.views(gradient)
        g["bias"][0] = dz.sum()
        g["linear"][:] = np.bincount(index.ravel(), np.repeat(dz, index.shape[1]), len(g["linear"]))
        g["out"][:] = layers[-1].T @ dz
        back = dz[:, None] * p["out"]
        for i in reversed(range(len(layers) - 1)):
            back = back * (layers[i + 1] > 0)
            g[f"w{i}"][:] = layers[i].T @ back
            g[f"b{i}"][:] = back.sum(axis=0)
            back = back @ p[f"w{i}"].T
        de = dz[:, None, None] * (s[:, None, :] - e) + back.reshape(e.shape)
        for f in range(e.shape[2]):
            g["embedding"][:, f] = np.bincount(index.ravel(), de[:, :, f].ravel(), len(g["linear"]))
        return float((np.logaddexp(0, z) - y * z).sum()), len(y), gradient

    return loss


def _codes(batch: pa.RecordBatch) -> np.ndarray:
    return np.array(batch.column("codes").to_pylist(), np.int64)


def coded(rows: DataFrame, fields: Sequence[str], label: str, *keep: str) -> DataFrame:
    """(label, codes, kept columns) of rows whose fields hold codes."""
    codes = F.array(*[F.col(f).cast("int") for f in fields]).alias("codes")
    return rows.select(F.col(label).cast("int").alias("label"), codes, *keep)


def fit(
    train: DataFrame, sizes: Sequence[int], key: str, factors: int = FACTORS, hidden: Sequence[int] = HIDDEN, epochs: int = 3,
    batches: int = 8, rate: float = 0.01, seed: int = 0,
) -> DeepFM:
    """Fit to `coded` rows; `key` names a kept column whose draw chooses the mini-batch."""
    model = begun(sizes, factors, hidden, seed)
    penalty = np.zeros(model.layout.size)
    model.layout.views(penalty)["linear"][:] = LINEAR_PENALTY / max(1, len(sizes))
    batch = F.floor(draw("deepfm", F.col(key)) / F.lit(-(-DRAW_SPAN // batches)))
    steps = descent.in_batches(train.select("label", "codes", key), batch, batches)
    loss = loss_of(model.layout, model.starts)
    return DeepFM(model.sizes, model.layout, descent.descend(steps, loss, model.flat, epochs, rate, penalty))


def scores(model: DeepFM, rows: DataFrame, *keep: str) -> DataFrame:
    """The kept columns and the predicted probability of `coded` rows."""
    shared = rows.sparkSession.sparkContext.broadcast((model.layout, model.starts, model.flat))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape, starts, flat = shared.value
        for batch in filter(len, batches):
            z = _forward(shape.views(flat), _codes(batch) + starts)[0]
            columns = [*(batch.column(c) for c in keep), pa.array(1 / (1 + np.exp(-z)))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "score"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.select("codes", *keep).mapInArrow(run, f"{kinds}, score double")
