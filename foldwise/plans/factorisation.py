"""A factorisation machine over several classes, fitted jointly.

Each class has a constant, a weight per input and a short vector per input;
the score of a class is its linear form plus the products of the vectors of
all pairs of inputs. The softmax loss of all classes together is minimised by
a limited-memory quasi-Newton method: a step asks for loss and gradient, which
every task sums over its rows in numpy and Spark sums over the tasks. The rows
are written once as blocks of numbers, which all steps read.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from foldwise.plans.blocks import Blocks, matrix, stretches
from foldwise.plans.boosting import softmax


def scores(x: np.ndarray, theta: np.ndarray, n_class: int, factors: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores (rows, classes) and the sums of the factors (rows, classes, factors)."""
    width = x.shape[1]
    b, w, v = _parts(theta, n_class, width, factors)
    s = (x @ v.transpose(1, 0, 2).reshape(width, -1)).reshape(len(x), n_class, factors)
    return b + x @ w.T + 0.5 * ((s**2).sum(2) - x**2 @ (v**2).sum(2).T), s


def _parts(theta: np.ndarray, n_class: int, width: int, factors: int):
    b, w, v = np.split(theta, [n_class, n_class * (1 + width)])
    return b, w.reshape(n_class, width), v.reshape(n_class, width, factors)


def loss_and_gradient(x, y, weight, theta, n_class, factors) -> tuple[float, np.ndarray]:
    """Sums over the rows."""
    z, s = scores(x, theta, n_class, factors)
    p = softmax(z)
    rows = np.arange(len(y))
    loss = -(weight * np.log(np.maximum(p[rows, y], 1e-300))).sum()
    d = p
    d[rows, y] -= 1
    d = d * weight[:, None]
    width = x.shape[1]
    _, _, v = _parts(theta, n_class, width, factors)
    pairs = x.T @ (d[:, :, None] * s).reshape(len(x), -1)
    gv = pairs.reshape(width, n_class, factors).transpose(1, 0, 2) - (d.T @ x**2)[:, :, None] * v
    return loss, np.concatenate([d.sum(0), (d.T @ x).ravel(), gv.ravel()])


def minimise(fn, start: np.ndarray, max_iter: int, tol: float, memory: int = 10) -> tuple[np.ndarray, float, bool]:
    """Limited-memory quasi-Newton steps with halving; (place, norm of the gradient there, whether it fell below tol)."""
    x, (value, grad) = start, fn(start)
    pairs: deque = deque(maxlen=memory)
    for _ in range(max_iter):
        norm = float(np.abs(grad).max())
        if norm < tol:
            return x, norm, True
        q, steps = grad.copy(), []
        for s, y, r in reversed(pairs):
            a = r * (s @ q)
            steps.append(a)
            q -= a * y
        if pairs:
            s, y, _ = pairs[-1]
            q *= (s @ y) / (y @ y)
        for (s, y, r), a in zip(pairs, reversed(steps)):
            q += s * (a - r * (y @ q))
        slope, length = -(grad @ q), 1.0 if pairs else min(1.0, 1.0 / np.linalg.norm(grad))
        for _ in range(20):
            new = x - length * q
            new_value, new_grad = fn(new)
            if new_value <= value + 1e-4 * length * slope:
                break
            length /= 2
        else:
            return x, norm, False
        s, y = new - x, new_grad - grad
        if s @ y > 1e-12:
            pairs.append((s, y, 1 / (s @ y)))
        x, value, grad = new, new_value, new_grad
    norm = float(np.abs(grad).max())
    return x, norm, norm < tol


class SoftmaxFM:
    """Estimator over a vector column. ``penalty`` is on the mean loss; inputs are scaled to deviation 1 inside."""

    def __init__(self, n_class, factors=4, max_iter=100, tol=1e-5, penalty=1e-4, features="features", label="label", weight=None, seed=1):
        self.n_class, self.factors, self.max_iter, self.tol, self.penalty = n_class, factors, max_iter, tol, penalty
        self.features, self.label, self.weight, self.seed = features, label, weight, seed

    def copy(self, extra=None) -> "SoftmaxFM":
        made = SoftmaxFM.__new__(SoftmaxFM)
        made.__dict__.update(self.__dict__)
        return made

    def hasParam(self, name: str) -> bool:  # noqa: N802
        return False

    def fit(self, df: DataFrame) -> "SoftmaxFMModel":
        width = len(df.select(self.features).first()[0])
        values = vector_to_array(self.features)
        facts = df.agg(*[F.struct(F.avg(values[j]), F.stddev_pop(values[j])) for j in range(width)]).first()
        mean = np.array([f[0] for f in facts])
        scale = np.array([f[1] or 1.0 for f in facts])
        weight = F.lit(1.0) if self.weight is None else F.col(self.weight).cast("double")
        rows = df.select(values.alias("x"), F.col(self.label).cast("int").alias("y"), weight.alias("w"))
        n_class, factors, penalty = self.n_class, self.factors, self.penalty
        size = n_class * (1 + width + width * factors)

        def packed(batch):
            x = (matrix(batch.column(0), width) - mean) / scale
            y, w = (batch.column(k).to_numpy() for k in (1, 2))
            return ([x[at], y[at], w[at]] for at in stretches(len(x), width))

        def read(block):
            return np.frombuffer(block[0]).reshape(-1, width), np.frombuffer(block[1], np.int32), np.frombuffer(block[2])

        with Blocks(["x", "y", "w"]) as table:
            table.write(rows, packed, deal=True)
            total = table.sums(lambda blocks: np.array([sum(read(b)[2].sum() for b in blocks)], float), 1)[0]

            def evaluate(theta: np.ndarray) -> tuple[float, np.ndarray]:
                def work(blocks):
                    out = np.zeros(size + 1)
                    for block in blocks:
                        loss, grad = loss_and_gradient(*read(block), theta, n_class, factors)
                        out[0] += loss
                        out[1:] += grad
                    return out

                out = table.sums(work, size + 1) / total
                # the constants are free
                free = np.append(np.zeros(n_class), theta[n_class:])
                return out[0] + penalty / 2 * (free @ free), out[1:] + penalty * free

            start = np.random.default_rng(self.seed).normal(0, 0.05, size)
            start[: n_class * (1 + width)] = 0
            theta, norm, reached = minimise(evaluate, start, self.max_iter, self.tol)
        return SoftmaxFMModel(theta, mean, scale, n_class, factors, self.features, norm, reached)


class SoftmaxFMModel:
    """``gradient`` is the largest slope where the fit stopped, ``converged`` tells whether it fell below the tolerance."""

    def __init__(self, theta, mean, scale, n_class, factors, features, gradient, converged):
        self.theta, self.mean, self.scale, self.n_class, self.factors = theta, mean, scale, n_class, factors
        self.features, self.gradient, self.converged = features, gradient, converged

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``probability`` and ``prediction``."""
        theta, mean, scale, n_class, factors = self.theta, self.mean, self.scale, self.n_class, self.factors

        @F.pandas_udf("array<double>")
        def fn(values: pd.Series) -> pd.Series:
            if not len(values):
                return pd.Series([], dtype=object)
            z, _ = scores((np.vstack(values.to_numpy()) - mean) / scale, theta, n_class, factors)
            return pd.Series(list(softmax(z)))

        rows = df.withColumn("_p", fn(vector_to_array(self.features)))
        best = (F.array_position("_p", F.array_max("_p")) - 1).cast("double")
        return rows.withColumns({"probability": array_to_vector("_p"), "prediction": best}).drop("_p")
