"""Learners: exact and iterative linear fits on Spark aggregates, and Spark ML estimators with the right options."""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.ml import Estimator
from pyspark.ml.classification import (
    FMClassifier,
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.regression import FMRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from foldwise.functions.hashing import hash_unit
from foldwise.operators.ordering import ordered_counts
from foldwise.operators.rows import rank_features
from foldwise.plans.boosting import Boosting
from foldwise.session import settle


class LinearFit:
    """Coefficients of a linear form over numeric columns."""

    def __init__(self, cols: Sequence[str], coefficients: Sequence[float]):
        self.cols, self.coefficients = list(cols), [float(c) for c in coefficients]

    def predict(self) -> Column:
        return sum((F.col(c) * F.lit(w) for c, w in zip(self.cols, self.coefficients)), F.lit(0.0))

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        return df.withColumn(out, self.predict())


class QuantileRegression:
    """Linear quantile regression without intercept.

    One column with positive values: the exact weighted quantile of y/x, found
    over value ranges. Several columns: iteratively reweighted least squares;
    a pass is one aggregation of the weighted cross products.
    """

    def __init__(self, q: float = 0.5, eps: float = 1e-6, max_iter: int = 1000, tol: float = 1e-6):
        self.q, self.eps, self.max_iter, self.tol = q, eps, max_iter, tol

    def fit(self, df: DataFrame, cols: Sequence[str], target: str) -> LinearFit:
        cols = list(cols)
        if len(cols) == 1:
            low = df.agg(F.min(cols[0])).first()[0]
            if low is not None and low > 0:
                return LinearFit(cols, [self._exact(df, cols[0], target)])
        return LinearFit(cols, self._reweighted(df, cols, target))

    def _exact(self, df: DataFrame, x: str, y: str) -> float:
        rows = df.select((F.col(y) / F.col(x)).alias("_ratio"), F.col(x).cast("double").alias("_x")).filter("_ratio is not null")
        counts = ordered_counts(rows, "_ratio", weight=F.col("_x"))
        reached = F.col("before") + F.col("cnt") >= F.lit(self.q) * F.col("total")
        return counts.filter(reached).agg(F.min("value")).first()[0]

    def _reweighted(self, df: DataFrame, cols: list[str], target: str) -> np.ndarray:
        rows = df.select(*[F.col(c).cast("double").alias(c) for c in cols], F.col(target).cast("double").alias("_y"))
        rows = rows.na.drop().persist()
        pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
        beta, step = None, None
        for _ in range(self.max_iter):
            if beta is None:
                weight = F.lit(1.0)
            else:
                residual = F.col("_y") - LinearFit(cols, beta).predict()
                side = F.when(residual >= 0, F.lit(self.q)).otherwise(F.lit(1 - self.q))
                weight = side / F.greatest(F.abs(residual), F.lit(self.eps))
            row = rows.select(*cols, "_y", weight.alias("_w")).agg(
                *[F.sum(F.col("_w") * F.col(cols[i]) * F.col(cols[j])).alias(f"a{i}_{j}") for i, j in pairs],
                *[F.sum(F.col("_w") * F.col(c) * F.col("_y")).alias(f"b{i}") for i, c in enumerate(cols)],
            ).first()
            a = np.zeros((len(cols), len(cols)))
            for i, j in pairs:
                a[i, j] = a[j, i] = row[f"a{i}_{j}"]
            new = np.linalg.lstsq(a, np.array([row[f"b{i}"] for i in range(len(cols))]), rcond=None)[0]
            step = None if beta is None else np.max(np.abs(new - beta) / np.maximum(np.abs(new), 1e-12))
            beta = new
            if step is not None and step < self.tol:
                break
        rows.unpersist()
        return beta


class MedianRegression(QuantileRegression):
    """The median form."""


class QuantileLearner:
    """Quantile regression with the interface of an estimator over a vector column, for presets."""

    def __init__(self, q: float = 0.5, features: str = "features", label: str = "label", **options):
        self.q, self.features, self.label, self.options = q, features, label, options

    def copy(self, extra=None) -> "QuantileLearner":
        return QuantileLearner(self.q, self.features, self.label, **self.options)

    def hasParam(self, name: str) -> bool:  # noqa: N802
        return False

    def fit(self, df: DataFrame) -> "QuantileModel":
        first = df.select(self.features).first()
        names = [f"_x{i}" for i in range(len(first[0]))]
        values = vector_to_array(self.features)
        rows = df.select(*[values[i].alias(n) for i, n in enumerate(names)], F.col(self.label).alias("_label"))
        fit = QuantileRegression(self.q, **self.options).fit(rows, names, "_label")
        return QuantileModel(fit.coefficients, self.features)


class QuantileModel:
    def __init__(self, coefficients: Sequence[float], features: str):
        self.coefficients, self.features = list(coefficients), features

    def transform(self, df: DataFrame) -> DataFrame:
        values = vector_to_array(self.features)
        terms = (values[i] * F.lit(w) for i, w in enumerate(self.coefficients))
        return df.withColumn("prediction", sum(terms, F.lit(0.0)))


class Ridge:
    """Linear regression with penalty ``alpha`` on the sum of squared errors and a free intercept.

    The library's solver minimises the mean squared error of the label divided
    by its standard deviation; its parameter is scaled so that ``alpha`` means
    the same whatever the rows and the label.
    """

    def __init__(self, alpha: float = 1.0, features: str = "features", label: str = "label"):
        self.alpha, self.features, self.label = alpha, features, label

    def copy(self, extra=None) -> "Ridge":
        return Ridge(self.alpha, self.features, self.label)

    def hasParam(self, name: str) -> bool:  # noqa: N802
        return False

    def fit(self, df: DataFrame):
        rows, std = df.agg(F.count(self.label), F.stddev_pop(self.label)).first()
        return LinearRegression(
            featuresCol=self.features,
            labelCol=self.label,
            regParam=self.alpha * (std or 1.0) / rows,
            elasticNetParam=0.0,
            standardization=False,
            solver="normal",
        ).fit(df)


def ridge(alpha: float = 1.0, **kw) -> Ridge:
    return Ridge(alpha, **kw)


def softmax_regression(reg: float = 0.0, **kw) -> LogisticRegression:
    return LogisticRegression(family="multinomial", regParam=reg, **kw)


def boosted(loss: str = "squared", n_class: int | None = None, **kw):
    """Gradient-boosted trees: regression by loss, two classes, or one ensemble with a softmax gradient for more."""
    if n_class is None:
        return GBTRegressor(lossType=loss, **kw)
    if n_class == 2:
        return GBTClassifier(**kw)
    return Boosting("softmax", n_class, **kw)


def forest(n_class: int | None = None, **kw) -> Estimator:
    return RandomForestRegressor(**kw) if n_class is None else RandomForestClassifier(**kw)


def fm(n_class: int | None = None, **kw) -> Estimator:
    """Factorisation machine; one model per class above two classes."""
    if n_class is None:
        return FMRegressor(**kw)
    one = FMClassifier(**kw)
    return one if n_class == 2 else OneVsRest(classifier=one)


def mlp(layers: Sequence[int], **kw) -> MultilayerPerceptronClassifier:
    return MultilayerPerceptronClassifier(layers=list(layers), **kw)


# fixed values: the classes that count double, and their weight
HEAVY_CLASSES = (0, 3, 4, 6)
HEAVY_WEIGHT = 2.0


def class_weight(df: DataFrame, label: str, heavy: Sequence = HEAVY_CLASSES, w: float = HEAVY_WEIGHT, out: str = "weight") -> DataFrame:
    return df.withColumn(out, F.when(F.col(label).isin(list(heavy)), F.lit(float(w))).otherwise(F.lit(1.0)))


def importances(model, features: Sequence[str], spark) -> DataFrame:
    """(feature, importance, place) of a fitted tree model."""
    return rank_features(dict(zip(features, model.featureImportances.toArray().tolist())), spark)


def holdout_split(df: DataFrame, key: str, frac: float = 0.2, seed=42) -> tuple[DataFrame, DataFrame]:
    test = hash_unit(F.col(key), seed) < frac
    return df.filter(~test), df.filter(test)


# fits that run side by side; each is a chain of Spark jobs, so the driver only waits
PARALLEL_FITS = 4


def side_by_side(work, items: Sequence, parallel: int = PARALLEL_FITS) -> list:
    """``work`` of every item, several at a time; results in the order of the items."""
    from concurrent.futures import ThreadPoolExecutor

    from pyspark import inheritable_thread_target
    from pyspark.sql import SparkSession

    session = SparkSession.getActiveSession()
    with ThreadPoolExecutor(max(1, parallel)) as pool:
        return list(pool.map(inheritable_thread_target(session)(work), items))


def grid_search(
    estimator, grid: Mapping[str, Sequence], df: DataFrame, key: str, score, frac: float = 0.2, larger: bool = False, seed=42, parallel: int = PARALLEL_FITS
) -> tuple[DataFrame, dict]:
    """Every grid point fitted on the same written training part and scored on the same written holdout, several at a time.

    ``estimator`` is a Spark estimator whose parameters the grid names, or a
    function that makes one from them. ``score`` maps a scored holdout to a
    one-row DataFrame with one number. Returns (table of parameters and score,
    best parameters).
    """
    train, held = map(settle, holdout_split(df, key, frac, seed))
    names = list(grid)
    points = [dict(zip(names, values)) for values in itertools.product(*grid.values())]

    def one(point: dict) -> float:
        if callable(estimator):
            chosen = estimator(**point)
        else:
            chosen = estimator.copy({estimator.getParam(n): v for n, v in point.items()})
        return float(score(chosen.fit(train).transform(held)).first()[0])

    rows = list(zip(points, side_by_side(one, points, parallel)))
    best = (max if larger else min)(rows, key=lambda r: r[1])[0]
    table = df.sparkSession.createDataFrame([(*[float(p[n]) for n in names], s) for p, s in rows], [*names, "score"])
    return table, best


def staged_scores(model, df: DataFrame, loss: str | None = None) -> list[float]:
    """Loss on a table after every boosting round; regression models need the name of the loss."""
    return list(model.evaluateEachIteration(df) if loss is None else model.evaluateEachIteration(df, loss))


# fixed values: learning rates tried, and the penalties per rate and per step of rounds
RATES = (0.01, 0.02, 0.03, 0.04, 0.05)
RATE_PENALTY, STEP_BONUS, ROUND_STEP = 0.1, 0.001, 500


def rate_round_search(
    df: DataFrame,
    key: str,
    label: str,
    rates: Sequence[float] = RATES,
    max_rounds: int = 2000,
    step: int = ROUND_STEP,
    seed=0,
    parallel: int = PARALLEL_FITS,
    **kw,
) -> tuple[DataFrame, float, int]:
    """Learning rate and rounds with the best ``AUC - 0.1 rate + 0.001 step number`` on a 20 % holdout.

    One fit per rate, at the largest number of rounds; the holdout is scored
    once for all numbers of rounds, since a shorter ensemble is a prefix of the
    longer one. Rates are fitted side by side.
    """
    from foldwise.plans.evaluate import auc

    train, held = map(settle, holdout_split(df, key, 0.2, seed))

    def one(rate: float) -> list[tuple[float, int, float]]:
        model = Boosting("logistic", rounds=max_rounds, rate=rate, label=label, **kw).fit(train)
        stages = model.staged(held, step).select("round", F.col(label).alias("y"), F.col("margins")[0].alias("margin"))
        found = auc(settle(stages), "y", "margin", ["round"]).collect()  # one row per stage
        return [(rate, r["round"], r["auc"] - RATE_PENALTY * rate + STEP_BONUS * (r["round"] // step - 1)) for r in found]

    rows = sorted(row for found in side_by_side(one, list(rates), parallel) for row in found)
    table = df.sparkSession.createDataFrame(rows, "rate double, rounds int, score double")
    best = max(rows, key=lambda r: r[2])
    return table, best[0], best[1]
