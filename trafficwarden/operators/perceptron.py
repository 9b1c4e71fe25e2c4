"""The fit of a multilayer perceptron with one hidden layer on sparse rows: same network, first weights and loss as the library's.

The library keeps every row as a dense block (16 KB a row with 2,000 n-grams); here rows stay sparse, and
a few hundred at a time are made dense for a matrix product. Tasks sum up gradients;
the driver adds up those of the tasks and holds weights and the last ten steps of L-BFGS. The result is the library's model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.serializers import CPickleSerializer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficwarden.operators.grams import GramWeights
from trafficwarden.operators.order import kept

#: Rows that are dense at once.
DENSE_ROWS = 256
#: Steps that L-BFGS remembers; tries of a step's length.
MEMORY, TRIES = 10, 20
#: Most tasks whose sums reach the driver in a step: about 1 MB each with 2,000 n-grams.
MOST_SUMS = 64


def _parts(weights: np.ndarray, layers: list[int]) -> list[np.ndarray]:
    a, h, k = layers
    ends = np.cumsum([a * h, h, h * k, k])
    return [weights[e - n : e].reshape(s) for e, n, s in zip(ends, (a * h, h, h * k, k), ((a, h), (h,), (h, k), (k,)))]


def gradient(weights: np.ndarray, layers: list[int], x: np.ndarray, y: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, float]:
    """Sums over dense rows, each as often as rows says: gradient of the cross-entropy, and the cross-entropy."""
    w1, b1, w2, b2 = _parts(weights, layers)
    hidden = 1 / (1 + np.exp(-(x @ w1 + b1)))
    out = hidden @ w2 + b2
    p = np.exp(out - out.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    at = np.arange(len(y)), y
    loss = -float((rows * np.log(np.maximum(p[at], 1e-300))).sum())
    p[at] -= 1
    p *= rows[:, None]
    back = (p @ w2.T) * hidden * (1 - hidden)
    return np.concatenate([(x.T @ back).ravel(), back.sum(0), (hidden.T @ p).ravel(), p.sum(0)]), loss


def _sparse(rows: DataFrame, text: str, found: GramWeights) -> DataFrame:
    """at, value, y, n of rows with the text, _y and _rows, written once."""
    shared = rows.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin = 0
            for n, ends, at, value in shared.value.rows(batch.column(0).to_pylist()):
                to = pa.array(np.append(0, ends).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(to, pa.array(at)), pa.ListArray.from_arrays(to, pa.array(value)), batch.column(1).slice(begin, n), batch.column(2).slice(begin, n)], ["at", "value", "y", "n"])
                begin += n

    return kept(rows.select(text, F.col("_y").cast("int"), F.col("_rows").cast("double")).mapInArrow(run, "at array<int>, value array<double>, y int, n double"))


def _summed(rows: DataFrame, weights: np.ndarray, layers: list[int]) -> tuple[np.ndarray, float]:
    """Gradient and cross-entropy of all rows: a task sums its own, at most ``MOST_SUMS`` sums are added up here."""
    size, pieces = len(weights) + 1, 8
    shared = rows.sparkSession.sparkContext.broadcast(weights)
    cuts = np.linspace(0, size, pieces + 1).astype(int)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for b in range(0, batch.num_rows, DENSE_ROWS):
                part = batch.slice(b, DENSE_ROWS)
                at, y, n = part.column(0), part.column(2).to_numpy(zero_copy_only=False), part.column(3).to_numpy(zero_copy_only=False)
                x = np.zeros((part.num_rows, layers[0]))
                x[np.repeat(np.arange(part.num_rows), np.diff(at.offsets.to_numpy())), at.flatten().to_numpy(zero_copy_only=False)] = part.column(1).flatten().to_numpy(zero_copy_only=False)
                g, loss = gradient(shared.value, layers, x, y, n)
                total[:-1] += g
                total[-1] += loss
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(pieces, dtype=np.int32)), pa.array([total[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())], ["piece", "sums"])

    out = np.zeros(size)
    for r in rows.coalesce(MOST_SUMS).mapInArrow(run, "piece int, sums binary").collect():  # one sum of all parameters a task
        out[cuts[r.piece] : cuts[r.piece + 1]] += np.frombuffer(r.sums)
    shared.unpersist()
    return out[:-1], float(out[-1])


def minimum(value: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, iterations: int, tol: float) -> np.ndarray:
    """L-BFGS with steps that meet the strong Wolfe conditions, until the value or the gradient hardly changes."""
    f, g = value(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for i in range(iterations):
        if np.linalg.norm(g) <= max(tol * abs(f), 1e-8):
            break
        d, a = -g, []
        for s, y in reversed(steps):
            a.append((s @ d) / (s @ y))
            d = d - a[-1] * y
        if steps:
            s, y = steps[-1]
            d = d * ((s @ y) / (y @ y))
        for (s, y), k in zip(steps, reversed(a)):
            d = d + (k - (y @ d) / (s @ y)) * s
        slope = g @ d
        if slope >= 0:
            d, steps = -g, []
            slope = g @ d
        low, high, t = 0.0, np.inf, 1.0 if steps else 1 / np.linalg.norm(g)
        for _ in range(TRIES):
            new = x + t * d
            f2, g2 = value(new)
            if not np.isfinite(f2) or f2 > f + 1e-4 * t * slope:
                high = t
            elif g2 @ d < 0.9 * slope:
                low = t
            else:
                break
            t = 2 * t if np.isinf(high) else (low + high) / 2
        if not np.isfinite(f2) or f2 >= f:
            break
        s, y = new - x, g2 - g
        if s @ y > 1e-12:
            steps = [*steps[-(MEMORY - 1) :], (s, y)]
        done = abs(f - f2) <= tol * max(abs(f), abs(f2), 1e-12)
        x, f, g = new, f2, g2
        if done:
            break
    return x


def fit(estimator: MultilayerPerceptronClassifier, rows: DataFrame, text: str, found: GramWeights, n: int) -> MultilayerPerceptronClassificationModel:
    """The estimator's model of rows with the text, _y and _rows, n in all."""
    spark, layers = rows.sparkSession, list(estimator.getLayers())
    blank = spark.createDataFrame([(float(layers[-1] - 1), Vectors.sparse(layers[0], {}))], [estimator.getLabelCol(), estimator.getFeaturesCol()])
    model = estimator.copy().setMaxIter(0).fit(blank)  # with the library's first weights
    sparse = _sparse(rows, text, found)

    def value(weights: np.ndarray) -> tuple[float, np.ndarray]:
        g, loss = _summed(sparse, weights, layers)
        return loss / max(n, 1), g / max(n, 1)

    weights, jvm = minimum(value, model.weights.toArray(), estimator.getMaxIter(), estimator.getTol()), spark._jvm
    vector = jvm.org.apache.spark.ml.python.MLSerDe.loads(bytearray(CPickleSerializer().dumps(DenseVector(weights))))
    java = jvm.org.apache.spark.ml.classification.MultilayerPerceptronClassificationModel(model.uid, vector)
    model._java_obj.copyValues(java, jvm.org.apache.spark.ml.param.ParamMap.empty())
    java.set(java.getParam("maxIter"), estimator.getMaxIter())
    out = MultilayerPerceptronClassificationModel(java)
    out._resetUid(model.uid)
    out._transfer_params_from_java()
    return out
