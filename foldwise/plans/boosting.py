"""Gradient-boosted trees with one ensemble for all classes.

Inputs are cut into bins once. A round grows one tree per output (one for a
number or two classes, one per class for more), all of them level by level: a
level is one pass in which every task adds up gradients and curvatures per
output, node, input and bin in numpy, Spark sums these tables over the tasks,
and the driver picks the splits. What the driver receives has the size of the
model, not of the data. The bins are written once as blocks of bytes. Margins of
the rows are written anew every few rounds; in between they follow from the
trees grown since.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from foldwise.plans.blocks import Blocks, blocks_of, matrix, stretches

# rounds whose trees are walked again before the margins are written
ROUNDS_TOGETHER = 8
# distinct values of an input that are all cut points; beyond, quantiles
ALL_VALUES = 64
# nodes of a tree up to which rows descend as masks of whole blocks
MASKED_NODES = 127


@dataclass(frozen=True)
class Tree:
    """A binary tree in heap order: node i has the children 2i + 1 and 2i + 2; feature -1 is a leaf."""

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray

    @staticmethod
    def empty(depth: int) -> "Tree":
        n = 2 ** (depth + 1) - 1
        return Tree(np.full(n, -1), np.zeros(n, int), np.zeros(n))

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The deepest node each row reaches; ``bins`` has one line per input."""
        n = bins.shape[1]
        if len(self.feature) <= MASKED_NODES:
            at = np.zeros(n, np.uint8)
            self._mark(0, bins, np.ones(n, bool), at)
            return at
        at, rows = np.zeros(n, int), np.arange(n)
        for _ in range(int(np.log2(len(self.feature) + 1))):
            inner = self.feature[at] >= 0
            right = bins[np.maximum(self.feature[at], 0), rows] > self.bin[at]
            at = np.where(inner, 2 * at + 1 + right, at)
        return at

    def _mark(self, i: int, bins: np.ndarray, here: np.ndarray, at: np.ndarray) -> None:
        """Enters the nodes below node i for the rows that are ``here``."""
        f = self.feature[i]
        if f < 0:
            at |= here.view(np.uint8) * np.uint8(i)
            return
        right = bins[f] > self.bin[i]
        self._mark(2 * i + 1, bins, here & ~right, at)
        self._mark(2 * i + 2, bins, here & right, at)

    def values(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.nodes(bins)]


def margins(rounds: Sequence[Sequence[Tree]], bins: np.ndarray, start: np.ndarray) -> np.ndarray:
    out = start.copy()
    for trees in rounds:
        for k, tree in enumerate(trees):
            out[:, k] += tree.values(bins)
    return out


def softmax(m: np.ndarray) -> np.ndarray:
    e = np.exp(m - m.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _softmax_steps(m, y):
    p = softmax(m)
    return p - (np.arange(m.shape[1]) == y[:, None]), p * (1 - p)


def _logistic_steps(m, y):
    p = 1 / (1 + np.exp(-m))
    return p - y[:, None], p * (1 - p)


def _squared_steps(m, y):
    return m - y[:, None], np.ones_like(m)


def fair_steps(c: float):
    """The fair loss with scale ``c``."""

    def steps(m, y):
        d = m - y[:, None]
        return c * d / (np.abs(d) + c), c**2 / (np.abs(d) + c) ** 2

    return steps


OBJECTIVES = {"softmax": _softmax_steps, "logistic": _logistic_steps, "squared": _squared_steps}


def _bin_values(values: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """Number of cut points below each value; a missing value lies above all."""
    return np.stack([np.searchsorted(c, values[:, j], "left") for j, c in enumerate(cuts)], axis=1)


def best_split(g: np.ndarray, h: np.ndarray, penalty: float, least: float) -> tuple[float, int, int, tuple, tuple]:
    """(gain, input, bin, left sums, right sums) from the sums per input and bin; ties take the first."""
    left_g, left_h = np.cumsum(g, axis=1)[:, :-1], np.cumsum(h, axis=1)[:, :-1]
    all_g, all_h = g[0].sum(), h[0].sum()
    right_g, right_h = all_g - left_g, all_h - left_h
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left_g**2 / (left_h + penalty) + right_g**2 / (right_h + penalty) - all_g**2 / (all_h + penalty)
    gain = np.where((left_h >= least) & (right_h >= least), np.round(gain, 9), -np.inf)
    if not gain.size:
        return -np.inf, 0, 0, (0, 0), (0, 0)
    f, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
    return gain[f, b], int(f), int(b), (left_g[f, b], left_h[f, b]), (right_g[f, b], right_h[f, b])


class Boosting:
    """Estimator over a vector column. ``objective``: softmax, logistic, squared, or a function of (margins, labels)
    that gives gradients and curvatures; ``n_class`` is the number of outputs of softmax."""

    def __init__(
        self,
        objective: str | Callable = "softmax",
        n_class: int = 1,
        rounds: int = 100,
        depth: int = 5,
        rate: float = 0.1,
        bins: int = 32,
        penalty: float = 1.0,
        least: float = 1e-3,
        features: str = "features",
        label: str = "label",
        weight: str | None = None,
    ):
        self.objective, self.n_class, self.rounds, self.depth, self.rate = objective, n_class, rounds, depth, rate
        self.bins, self.penalty, self.least = bins, penalty, least
        self.features, self.label, self.weight = features, label, weight

    def copy(self, extra=None) -> "Boosting":
        made = Boosting.__new__(Boosting)
        made.__dict__.update(self.__dict__)
        return made

    def hasParam(self, name: str) -> bool:  # noqa: N802
        return False

    def _cuts(self, df: DataFrame, width: int) -> list[np.ndarray]:
        """Cut points of each input: midpoints of all values if they are few, else quantiles."""
        values = vector_to_array(self.features)
        wide = df.select(*[values[j].alias(f"x{j}") for j in range(width)])
        known = lambda c: ~F.isnan(c) & c.isNotNull()
        counts = wide.agg(*[F.approx_count_distinct(f"x{j}").alias(f"x{j}") for j in range(width)]).first()
        few = [j for j in range(width) if counts[j] <= ALL_VALUES]
        many = [j for j in range(width) if counts[j] > ALL_VALUES]
        cuts: dict[int, np.ndarray] = {}
        if few:
            sets = wide.agg(*[F.collect_set(F.when(known(F.col(f"x{j}")), F.col(f"x{j}"))).alias(f"x{j}") for j in few]).first()
            for j in few:
                v = np.sort(np.array(sets[f"x{j}"], float))
                cuts[j] = (v[1:] + v[:-1]) / 2
        if many:
            shares = [i / self.bins for i in range(1, self.bins)]
            found = wide.approxQuantile([f"x{j}" for j in many], shares, 0.1 / self.bins)
            cuts |= {j: np.unique(f) for j, f in zip(many, found)}
        return [cuts[j] for j in range(width)]

    def fit(self, df: DataFrame) -> "BoostingModel":
        width = len(df.select(self.features).first()[0])
        outputs = self.n_class if self.objective == "softmax" else 1
        steps = OBJECTIVES[self.objective] if isinstance(self.objective, str) else self.objective
        cuts = self._cuts(df, width)
        weight = F.lit(1.0) if self.weight is None else F.col(self.weight).cast("double")
        start = 0.0
        if outputs == 1 and self.objective != "logistic":
            start = float(df.agg(F.avg(F.col(self.label).cast("double"))).first()[0])
        rows = df.select(vector_to_array(self.features).alias("x"), F.col(self.label).cast("double").alias("y"), weight.alias("w"))
        n_bins = max(len(c) for c in cuts) + 1
        kind = np.min_scalar_type(n_bins)

        def packed(batch):
            values = matrix(batch.column(0), width)
            y, w = (batch.column(k).to_numpy() for k in (1, 2))
            for at in stretches(len(y), max(width, outputs)):
                bins = _bin_values(values[at], cuts).T.astype(kind)
                yield bins, y[at], w[at], np.full((len(y[at]), outputs), start)

        done, recent = [], []
        with Blocks(["bins", "y", "w", "m"]) as table:
            table.write(rows, packed, deal=True)
            for k in range(self.rounds):
                trees = self._grow(table, kind, recent, outputs, width, n_bins, steps)
                done.append(trees)
                recent.append(trees)
                if len(recent) == ROUNDS_TOGETHER and k + 1 < self.rounds:
                    table.write(table.rows, _moved(recent, kind, width, outputs))
                    recent = []
        return BoostingModel(done, cuts, outputs, start, self.objective, self.features)

    def _grow(self, table, kind, recent, outputs, width, n_bins, steps) -> list[Tree]:
        trees = [Tree.empty(self.depth) for _ in range(outputs)]
        for level in range(self.depth):
            first, n_nodes = 2**level - 1, 2**level
            open_ = {(k, i) for k in range(outputs) for i in range(first, first + n_nodes) if self._reached(trees[k], i)}
            if not open_:
                break
            found = _histograms(table, kind, recent, trees, outputs, width, n_bins, first, n_nodes, steps)
            for k, i in sorted(open_):
                g, h = found[k, i - first]
                gain, f, b, left, right = best_split(g, h, self.penalty, self.least)
                leaf = lambda s: -self.rate * s[0] / (s[1] + self.penalty)
                if level == 0:
                    trees[k].value[i] = leaf((g[0].sum(), h[0].sum()))
                if gain > 1e-9:
                    trees[k].feature[i], trees[k].bin[i] = f, b
                    trees[k].value[2 * i + 1], trees[k].value[2 * i + 2] = leaf(left), leaf(right)
        return trees

    @staticmethod
    def _reached(tree: Tree, i: int) -> bool:
        return i == 0 or tree.feature[(i - 1) // 2] >= 0


def _read(block, kind, width: int, outputs: int):
    bins = np.frombuffer(block[0], kind).reshape(width, -1)
    return bins, np.frombuffer(block[1]), np.frombuffer(block[2]), np.frombuffer(block[3]).reshape(-1, outputs)


def _moved(rounds, kind, width, outputs):
    def work(batch):
        for block in blocks_of([batch]):
            bins, y, w, m = _read(block, kind, width, outputs)
            yield bins, y, w, margins(rounds, bins, m)

    return work


def _histograms(table, kind, recent, trees, outputs, width, n_bins, first, n_nodes, steps) -> np.ndarray:
    """Sums of gradients and curvatures (output, node, [gradient, curvature], input, bin) of one level."""
    shape = (outputs, n_nodes, 2, width, n_bins)

    def work(blocks):
        total = np.zeros(shape)
        for block in blocks:
            bins, y, w, m = _read(block, kind, width, outputs)
            g, h = (np.ascontiguousarray((s * w[:, None]).T) for s in steps(margins(recent, bins, m), y))
            for k, tree in enumerate(trees):
                node, here, gk, hk = tree.nodes(bins), bins, g[k], h[k]
                inside = (node >= first) & (node < first + n_nodes)
                if not inside.all():
                    node, here, gk, hk = node[inside], bins[:, inside], gk[inside], hk[inside]
                base = (node.astype(np.intp) - first) * n_bins
                for j in range(width):
                    slot = base + here[j]
                    for s, v in enumerate((gk, hk)):
                        total[k, :, s, j] += np.bincount(slot, v, n_nodes * n_bins).reshape(n_nodes, n_bins)
        return total.reshape(-1)

    return table.sums(work, int(np.prod(shape))).reshape(shape)  # as many rows reach the driver as the level has bins


class BoostingModel:
    """Trees of all rounds; ``transform`` adds ``margins``, ``prediction`` and, for classes, ``probability``."""

    def __init__(self, rounds, cuts, outputs, start, objective, features):
        self.rounds, self.cuts, self.outputs, self.start = rounds, cuts, outputs, start
        self.objective, self.features = objective, features

    def _margins(self, at: Sequence[int]):
        """Margins after each of the given numbers of rounds, in one pass over the trees."""
        rounds, cuts, start, outputs = self.rounds, self.cuts, self.start, self.outputs

        @F.pandas_udf("array<array<double>>")
        def fn(values: pd.Series) -> pd.Series:
            if not len(values):
                return pd.Series([], dtype=object)
            bins = np.ascontiguousarray(_bin_values(np.vstack(values.to_numpy()), cuts).T)
            m, before, stages = np.full((len(values), outputs), start), 0, []
            for stop in at:
                m = margins(rounds[before:stop], bins, m)
                stages.append(m)
                before = stop
            return pd.Series([[s.tolist() for s in row] for row in np.stack(stages, axis=1)])

        return fn

    def _scored(self, df: DataFrame) -> DataFrame:
        if self.objective == "softmax":
            top = F.array_max("margins")
            e = F.transform("margins", lambda x: F.exp(x - top))
            total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
            shares = F.transform(e, lambda x: x / total)
            best = (F.array_position("margins", top) - 1).cast("double")
        elif self.objective == "logistic":
            p = 1 / (1 + F.exp(-F.col("margins")[0]))
            shares, best = F.array(1 - p, p), (F.col("margins")[0] > 0).cast("double")
        else:
            return df.withColumn("prediction", F.col("margins")[0])
        return df.withColumns({"probability": array_to_vector(shares), "prediction": best})

    def transform(self, df: DataFrame) -> DataFrame:
        made = self._margins([len(self.rounds)])(vector_to_array(self.features))[0]
        return self._scored(df.withColumn("margins", made))

    def staged(self, df: DataFrame, every: int = 1) -> DataFrame:
        """The rows once per stage: ``round`` (every, 2 every, ... and the last) with the margins after it."""
        at = sorted({*range(every, len(self.rounds) + 1, every), len(self.rounds)})
        made = self._margins(at)(vector_to_array(self.features))
        numbers = F.array(*[F.lit(r) for r in at])
        pairs = F.explode(F.arrays_zip(numbers.alias("r"), made.alias("m")))
        rows = df.select("*", pairs.alias("_stage"))
        return self._scored(rows.select(*df.columns, F.col("_stage.r").alias("round"), F.col("_stage.m").alias("margins")))

    def splits(self) -> list[tuple[int, int, int, int, float | None, float]]:
        """(round, output, node, input, cut, value) of every node that rows can reach."""
        out = []
        for r, trees in enumerate(self.rounds):
            for k, tree in enumerate(trees):
                for i in range(len(tree.feature)):
                    if i == 0 or tree.feature[(i - 1) // 2] >= 0:
                        f = int(tree.feature[i])
                        cut = float(self.cuts[f][tree.bin[i]]) if f >= 0 else None
                        out.append((r, k, i, f, cut, float(tree.value[i])))
        return out


def staged_loss(model: BoostingModel, df: DataFrame, loss: Column, every: int = 1) -> DataFrame:
    """(round, loss): the mean of a loss column expression over ``prediction`` and ``margins`` after every stage, in one pass."""
    return model.staged(df, every).groupBy("round").agg(F.avg(loss).alias("loss"))
