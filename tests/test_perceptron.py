import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from trolley.operators import ctr, descent, perceptron


def table(spark, n=600):
    rng = np.random.default_rng(4)
    data = []
    for i in range(n):
        a, b = (int(x) for x in rng.integers(0, 3, 2))
        sparse = Vectors.sparse(6, [a, 3 + b], [1.0, 2.0])
        data.append((i, int((a == b) != (i % 10 == 0)), sparse if i % 3 else Vectors.dense(sparse.toArray())))
    return spark.createDataFrame(data, ["event_id", "click", "features"]).repartition(1).cache()


def test_same_model_as_spark(spark):
    rows = table(spark)
    own = perceptron.fit(rows, "click", (5, 4), 15, 0)
    layers = [6, 5, 4, 2]
    theirs = MultilayerPerceptronClassifier(labelCol="click", layers=layers, maxIter=15, seed=0, blockSize=600).fit(rows)
    as_given = perceptron.Perceptron(own.layout, theirs.weights.toArray())
    ours = {r.event_id: r.score for r in ctr.scores(as_given, rows, "event_id").collect()}
    want = {r.event_id: r.score for r in ctr.scores(theirs, rows, "event_id").collect()}
    assert max(abs(ours[k] - want[k]) for k in want) < 1e-9  # the same forward pass
    fitted = {r.event_id: r.score for r in ctr.scores(own, rows, "event_id").collect()}
    assert max(abs(fitted[k] - want[k]) for k in want) < 0.05  # and the same fit


def test_gradient(spark):
    rows = table(spark, 40).select(F.col("click").alias("label"), F.unwrap_udt("features").alias("features"))
    batch = rows.toArrow().combine_chunks().to_batches()[0]
    shape = perceptron.Perceptron.shape([6, 3, 2, 2])
    flat, loss = np.random.default_rng(1).normal(size=shape.size), perceptron.loss_of(shape)
    gradient = loss(batch, flat)[2]
    for i in range(shape.size):
        move = np.zeros(shape.size)
        move[i] = 1e-6
        assert gradient[i] == pytest.approx((loss(batch, flat + move)[0] - loss(batch, flat - move)[0]) / 2e-6, rel=1e-4, abs=1e-5)


def test_minimised():
    def rosenbrock(x):
        a, b = x
        return (1 - a) ** 2 + 100 * (b - a * a) ** 2, np.array([-2 * (1 - a) - 400 * a * (b - a * a), 200 * (b - a * a)])

    assert np.allclose(descent.minimised(rosenbrock, np.array([-1.2, 1.0]), 200, tolerance=1e-14), 1, atol=1e-5)
    assert np.array_equal(descent.minimised(lambda x: (0.0, np.zeros(2)), np.ones(2), 5), np.ones(2))


def test_rows_as_wide_as_all_values_are_not_made(spark):
    """A million columns and two values a row: dense blocks of 128 rows would take a gigabyte each."""
    wide = 1_000_000
    features = [Vectors.sparse(wide, [i % 7, wide - 1 - i % 5], [1.0, 1.0]) for i in range(256)]
    struct = pa.StructArray.from_arrays(
        [pa.array([0] * 256, pa.int8()), pa.array([wide] * 256, pa.int32()), pa.array([list(map(int, f.indices)) for f in features], pa.list_(pa.int32())),
         pa.array([list(f.values) for f in features], pa.list_(pa.float64()))],
        names=["type", "size", "indices", "values"],
    )
    shape = perceptron.Perceptron.shape([wide, 2, 2])
    batch = pa.RecordBatch.from_arrays([pa.array([i % 2 for i in range(256)]), struct], names=["label", "features"])
    gradient = perceptron.loss_of(shape)(batch, np.zeros(shape.size) + 0.1)[2]
    assert np.count_nonzero(gradient[: 2 * wide]) <= 2 * 12
