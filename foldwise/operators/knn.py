"""Exact k-nearest-neighbour join.

Base rows belong to the nearest of a bounded number of pivots. The distance to
a pivot and the radius of its cell bound every distance, so a query visits only
the cells that can hold one of its k neighbours. Small neighbouring cells are
packed into one, large ones cut into blocks, and queries into chunks, all of
bounded size; each block and chunk meet once, in numpy, and hand on k candidates
per query. One matrix product bounds the distances of a block; only rows that
the bounds leave over are measured exactly.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from foldwise.session import settle

BLOCK_ROWS = 20_000
CHUNK_ROWS = 100_000
# queries compared at a time inside a task
BATCH_ROWS = 500
# a smaller chunk is not worth another copy of the block
LEAST_CHUNK = 2_000
# rows of a block that give the first bound
FIRST_ROWS = 2_000
MAX_PIVOTS = 256


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances, summed over one dimension after the other."""
    squares = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        squares += (a[:, j, None] - b[None, :, j]) ** 2
    return np.sqrt(squares)


def _nearest(a: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, distance) of the k nearest rows of b to every row of a, ties by the place in b.

    Squares from a matrix product are wrong by at most ``slack``; rows beyond the
    k-th of them by more than that cannot be among the nearest.
    """
    take = min(k, len(b))
    if np.isfinite(a).all() and np.isfinite(b).all():
        middle = b.mean(axis=0)
        x, y = a - middle, b - middle
        long_x, long_y = (x * x).sum(axis=1), (y * y).sum(axis=1)
        slack = 8 * (a.shape[1] + 8) * np.finfo(float).eps * (np.sqrt(long_x) + np.sqrt(long_y.max())) ** 2
        # what moving both to the middle rounds off
        slack += 64 * a.shape[1] * np.finfo(float).eps * (np.abs(a).max() + np.abs(b).max()) * (np.sqrt(long_x) + np.sqrt(long_y.max()))
        d = x @ (y.T * -2.0)
        d += long_y
        d += long_x[:, None]
        some = max(take, min(FIRST_ROWS, len(b)))
        bound = np.partition(d[:, :some], take - 1, axis=1)[:, take - 1] + 2 * slack
        left = np.flatnonzero(d <= bound[:, None])
        r, c = np.divmod(left, len(b))
        if some < len(b):
            # the k-th of the rows left over is the k-th of all
            near = d.ravel()[left]
            order = np.lexsort((near, r))
            first = np.searchsorted(r, np.arange(len(a)))
            bound = near[order][first + take - 1] + 2 * slack
            kept = near <= bound[r]
            r, c = r[kept], c[kept]
        del d
    else:
        r, c = np.divmod(np.arange(len(a) * len(b)), len(b))
    squares = np.zeros(len(r))
    for j in range(a.shape[1]):
        squares += (a[r, j] - b[c, j]) ** 2
    dist = np.sqrt(squares)
    order = np.lexsort((c, dist, r))
    place = np.arange(len(r)) - np.searchsorted(r, r)
    order = order[place < take]
    return r[order], c[order], dist[order]


def _packs(pivots: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The pack of every cell: cells along a chain of nearest pivots, up to ``most`` rows in a pack, or one cell."""
    d = _distances(pivots, pivots)
    pack, here, number, rows = np.zeros(len(pivots), dtype=int), 0, 0, 0
    free = np.ones(len(pivots), dtype=bool)
    while True:
        free[here] = False
        if rows and rows + counts[here] > most:
            number, rows = number + 1, 0
        pack[here] = number
        rows += counts[here]
        if not free.any():
            return pack
        here = int(np.where(free, d[here], np.inf).argmin())


def _nearest_pivot(pivots: np.ndarray):
    @F.pandas_udf("struct<cell int, away double>")
    def assign(vec: pd.Series) -> pd.DataFrame:
        if not len(vec):
            return pd.DataFrame({"cell": pd.Series(dtype="int32"), "away": pd.Series(dtype="float64")})
        d = _distances(np.vstack(vec.to_numpy()), pivots)
        return pd.DataFrame({"cell": d.argmin(axis=1).astype("int32"), "away": d.min(axis=1)})

    return assign


def _cells_to_visit(pivots: np.ndarray, radius: np.ndarray, counts: np.ndarray, k: int):
    """Cells whose lower bound does not exceed an upper bound of the k-th distance."""

    @F.pandas_udf("array<int>")
    def visit(vec: pd.Series) -> pd.Series:
        if not len(vec):
            return pd.Series([], dtype=object)
        d = _distances(np.vstack(vec.to_numpy()), pivots)
        upper, lower = d + radius[None, :], d - radius[None, :]
        out = []
        for up, low in zip(upper, lower):
            order = np.argsort(up, kind="stable")
            reach = np.searchsorted(np.cumsum(counts[order]), k)
            # a little slack keeps cells at the rim in spite of rounding
            bound = np.inf if reach >= len(order) else up[order[reach]] * (1 + 1e-9)
            out.append(np.flatnonzero((low <= bound) & (counts > 0)).astype("int32"))
        return pd.Series(out)

    return visit


def knn_join(
    query: DataFrame,
    base: DataFrame,
    key: str,
    vec: str,
    k: int,
    block_rows: int = BLOCK_ROWS,
    chunk_rows: int = CHUNK_ROWS,
    pivots: int | None = None,
    others: bool = False,
) -> DataFrame:
    """(key, base_id, dist, place): the k nearest base rows of every query row, ties by base id.

    ``others`` leaves out the base row with the query's own key. An empty base
    gives no rows.
    """
    wanted_k, k = k, k + others
    n_base = base.count()
    wanted = pivots or min(MAX_PIVOTS, max(1, math.isqrt(n_base) // 4))
    # any points serve as pivots; the sample is bounded
    sample = base.select(vec).orderBy(F.xxhash64(key)).limit(wanted).collect()
    if not sample:
        nothing = query.select(key, F.lit(None).cast(base.schema[key].dataType).alias("base_id"), F.lit(0.0).alias("dist"), F.lit(0).alias("place"))
        return nothing.limit(0)
    points = np.array([r[0] for r in sample], dtype=float)
    placed = base.select(F.col(key).alias("base_id"), F.col(vec).alias("_vec"), _nearest_pivot(points)(F.col(vec)).alias("_p"))
    placed = settle(placed.select("base_id", "_vec", "_p.cell", "_p.away"))
    facts = {r["cell"]: r for r in placed.groupBy("cell").agg(F.max("away").alias("radius"), F.count(F.lit(1)).alias("n")).collect()}
    radius = np.array([facts[i]["radius"] if i in facts else 0.0 for i in range(len(points))])
    counts = np.array([facts[i]["n"] if i in facts else 0 for i in range(len(points))])

    packs = _packs(points, counts, block_rows)
    sizes = np.bincount(packs, weights=counts).astype(int).tolist()
    pack_of = F.array(*[F.lit(int(n)) for n in packs])

    visits = settle(
        query.select(F.col(key).alias("_q"), F.col(vec).alias("_vec"), _cells_to_visit(points, radius, counts, k)(F.col(vec)).alias("_cells"))
    )
    # a pack is visited once, however many of its cells can hold a neighbour
    wanted_packs = F.array_distinct(F.transform("_cells", lambda c: F.element_at(pack_of, c + 1)))
    left = visits.select("_q", "_vec", F.explode(wanted_packs).alias("pack"))
    visitors = dict(left.groupBy("pack").agg(F.count(F.lit(1))).collect())  # one row per pack

    def per_pack(numbers: list[int]):
        return F.element_at(F.array(*[F.lit(n) for n in numbers]), F.col("pack") + 1)

    # a pack is cut into blocks of base rows and chunks of its visitors; each block meets each chunk once
    blocks = [max(1, math.ceil(n / block_rows)) for n in sizes]
    pairs = sum(n * blocks[p] for p, n in visitors.items())
    cores = query.sparkSession.sparkContext.defaultParallelism
    chunk_rows = min(chunk_rows, max(LEAST_CHUNK, math.ceil(pairs / (2 * cores))))
    n_blocks = per_pack(blocks)
    n_chunks = per_pack([max(1, math.ceil(visitors.get(p, 0) / chunk_rows)) for p in range(len(sizes))])
    left = left.withColumn("block", F.explode(F.sequence(F.lit(0), n_blocks - 1))).withColumn(
        "chunk", F.pmod(F.xxhash64("_q"), n_chunks).cast("int")
    )
    right = (
        placed.withColumn("pack", F.element_at(pack_of, F.col("cell") + 1))
        .filter(F.col("pack").isin(list(visitors)))
        .withColumn("block", F.pmod(F.xxhash64("base_id"), n_blocks).cast("int"))
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), n_chunks - 1)))
        .select("base_id", "_vec", "pack", "block", "chunk")
    )
    schema = T.StructType(
        [
            T.StructField("_q", query.schema[key].dataType),
            T.StructField("base_id", base.schema[key].dataType),
            T.StructField("dist", T.DoubleType()),
        ]
    )

    def best(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if q.empty or b.empty:
            return pd.DataFrame({"_q": q["_q"][:0], "base_id": b["base_id"][:0], "dist": pd.Series(dtype=float)})
        b = b.sort_values("base_id", kind="stable")
        ids, points_b = b["base_id"].to_numpy(), np.vstack(b["_vec"].to_numpy())
        parts = []
        for start in range(0, len(q), BATCH_ROWS):
            some = q.iloc[start : start + BATCH_ROWS]
            r, c, dist = _nearest(np.vstack(some["_vec"].to_numpy()), points_b, k)
            parts.append(pd.DataFrame({"_q": some["_q"].to_numpy()[r], "base_id": ids[c], "dist": dist}))
        return pd.concat(parts, ignore_index=True)

    cut = ["pack", "block", "chunk"]
    near = left.groupBy(*cut).cogroup(right.groupBy(*cut)).applyInPandas(best, schema)
    if others:
        near, k = near.filter(~F.col("_q").eqNullSafe(F.col("base_id"))), wanted_k
    place = F.row_number().over(Window.partitionBy("_q").orderBy("dist", "base_id"))
    done = near.withColumn("place", place).filter(F.col("place") <= k)
    return done.select(F.col("_q").alias(key), "base_id", "dist", "place")


def knn_predict(query, base, key, vec, target, k, weight="uniform", **options) -> DataFrame:
    """(key, value): mean of the neighbours' target, plain or weighted by 1/distance.

    With the distance weight, neighbours at distance 0 decide alone.
    """
    near = knn_join(query, base, key, vec, k, **options)
    labels = base.select(F.col(key).alias("base_id"), F.col(target).cast("double").alias("_y"))
    rows = near.join(labels, "base_id")
    if weight == "uniform":
        return rows.groupBy(key).agg(F.avg("_y").alias("value"))
    exact = F.col("dist") == 0
    same = F.avg(F.when(exact, F.col("_y")))
    share = F.when(~exact, 1 / F.nullif(F.col("dist"), F.lit(0.0)))
    return rows.groupBy(key).agg(F.coalesce(same, F.sum(share * F.col("_y")) / F.sum(share)).alias("value"))


def class_votes(near, base, key, label, n_classes, weight="uniform") -> DataFrame:
    """(key, c0..cn): share of the votes of neighbours that were found before, per class."""
    rows = near.join(base.select(F.col(key).alias("base_id"), F.col(label).alias("_y")), "base_id")
    if weight == "uniform":
        share = F.lit(1.0)
    else:
        share = 1 / F.greatest(F.col("dist"), F.lit(1e-300))
    total = F.sum(share)
    return rows.groupBy(key).agg(
        *[(F.sum(F.when(F.col("_y") == i, share).otherwise(F.lit(0.0))) / total).alias(f"c{i}") for i in range(n_classes)]
    )


def knn_class_votes(query, base, key, vec, label, k, n_classes, weight="uniform", **options) -> DataFrame:
    """(key, c0..cn): share of the neighbours' votes per class."""
    near = knn_join(query, base, key, vec, k, **options)
    return class_votes(near, base, key, label, n_classes, weight)


class KnnLearner:
    """Neighbour regression or class shares over a vector column, with the interface of an estimator for presets.

    Inputs are scaled to mean 0 and deviation 1 of the rows it is fitted on.
    The key of the training rows must be kept (``Preset.options["keep"]``).
    """

    def __init__(self, k: int, weight: str = "uniform", classes: int | None = None, key: str = "id", features: str = "features", label: str = "label"):
        self.k, self.weight, self.classes = k, weight, classes
        self.key, self.features, self.label = key, features, label

    def copy(self, extra=None) -> "KnnLearner":
        return KnnLearner(self.k, self.weight, self.classes, self.key, self.features, self.label)

    def hasParam(self, name: str) -> bool:  # noqa: N802
        return False

    def fit(self, df: DataFrame) -> "KnnModel":
        from pyspark.ml.feature import StandardScaler

        rows = settle(df.select(self.key, self.features, self.label))
        scaler = StandardScaler(inputCol=self.features, outputCol="_scaled", withMean=True).fit(rows)
        return KnnModel(self, scaler, rows)


class KnnModel:
    def __init__(self, learner: KnnLearner, scaler, rows: DataFrame):
        self.learner, self.scaler, self.rows = learner, scaler, rows

    def _scaled(self, df: DataFrame, *keep: str) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        return self.scaler.transform(df).select(self.learner.key, vector_to_array("_scaled").alias("_vec"), *keep)

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction``, or ``probability`` with the shares of the classes."""
        from pyspark.ml.functions import array_to_vector

        o = self.learner
        base, query = self._scaled(self.rows, o.label), self._scaled(df)
        if o.classes is None:
            found = knn_predict(query, base, o.key, "_vec", o.label, o.k, o.weight).withColumnRenamed("value", "prediction")
        else:
            found = knn_class_votes(query, base, o.key, "_vec", o.label, o.k, o.classes, o.weight)
            shares = F.array(*[f"c{i}" for i in range(o.classes)])
            found = found.select(o.key, array_to_vector(shares).alias("probability"))
        return df.join(found, o.key, "left")
