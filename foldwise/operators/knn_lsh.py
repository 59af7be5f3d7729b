"""Approximate k-nearest-neighbour join by random projections.

Each of several tables cuts the space by a few random hyperplanes through the
middle of the base rows; a base row lies in one bucket of each table. A query
visits its own bucket and those behind the planes it is nearest to, so few
tables suffice. Candidates of one bucket meet in blocks of bounded size, their
true distances are computed, and each block hands on k rows per query; a base
row found in several tables counts once.

The number of planes follows from the size of the base: a bucket holds about
``BUCKET_ROWS`` rows whatever the table's size, and a bucket that holds more is
cut into blocks which all its visitors see, so no candidate is left out.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from foldwise.operators.knn import BATCH_ROWS, _distances
from foldwise.session import settle

TABLES = 12
# probes of each table: the own bucket and the next ones
PROBES = 24
BUCKET_ROWS = 200
# base rows and queries of a bucket that meet in one task at most
BLOCK_ROWS = 20_000
CHUNK_ROWS = 20_000
# rows of the base that place the planes
SAMPLE_ROWS = 10_000


def _planes(base: DataFrame, vec: str, key: str, n_planes: int, tables: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions (tables, planes, width) and the median of a bounded sample along each."""
    sample = base.select(vec).orderBy(F.xxhash64(key)).limit(SAMPLE_ROWS).collect()
    points = np.array([r[0] for r in sample], dtype=float)
    rng = np.random.default_rng(seed)
    normal = rng.standard_normal((tables, n_planes, points.shape[1]))
    # directions between rows follow the spread of the data
    pairs = rng.integers(0, len(points), (2, tables, n_planes))
    between = points[pairs[0]] - points[pairs[1]]
    normal = np.where((np.abs(between).sum(2) > 0)[:, :, None], between + 0.1 * np.abs(between).mean() * normal, normal)
    return normal, np.median(np.einsum("nw,tpw->tpn", points, normal), axis=2)


def _buckets(normal: np.ndarray, middle: np.ndarray, probes: int):
    """For each vector the buckets to visit in every table: the own one first, then by the least distance crossed."""
    tables, n_planes, _ = normal.shape
    weight = 1 << np.arange(n_planes, dtype=np.int64)
    length = np.linalg.norm(normal, axis=2) + 1e-300
    near = min(n_planes, max(1, math.ceil(math.log2(probes)) + 2)) if probes > 1 else 0
    masks = np.arange(1 << near)

    @F.pandas_udf("array<struct<t:int,b:bigint>>")
    def visit(vec: pd.Series) -> pd.Series:
        if not len(vec):
            return pd.Series([], dtype=object)
        side = np.einsum("nw,tpw->ntp", np.vstack(vec.to_numpy()).astype(float), normal) - middle
        own = (side > 0) @ weight
        away = (side / length) ** 2
        order = np.argsort(away, axis=2)[:, :, :near]
        cost = np.take_along_axis(away, order, 2)
        flips = weight[order]
        bits = (masks[:, None] >> np.arange(near)) & 1
        total = cost @ bits.T.astype(float)
        change = flips @ bits.T
        take = np.argsort(total, axis=2, kind="stable")[:, :, :probes]
        found = own[:, :, None] ^ np.take_along_axis(change, take, 2)
        return pd.Series([[(t, int(b)) for t in range(tables) for b in row[t]] for row in found])

    return visit


def lsh_knn_join(
    query: DataFrame,
    base: DataFrame,
    key: str,
    vec: str,
    k: int,
    tables: int = TABLES,
    probes: int = PROBES,
    bucket_rows: int = BUCKET_ROWS,
    others: bool = False,
    seed: int = 17,
) -> DataFrame:
    """(key, base_id, dist, place): k near base rows of every query row, most of them the nearest.

    Distances are true ones. A query whose buckets hold fewer than k rows gets
    those; ``others`` leaves out the base row with the query's own key.
    """
    n_base = base.count()
    n_planes = max(1, math.ceil(math.log2(max(1, n_base) / bucket_rows)))
    if not n_base:
        nothing = query.select(key, F.lit(None).cast(base.schema[key].dataType).alias("base_id"), F.lit(0.0).alias("dist"), F.lit(0).alias("place"))
        return nothing.limit(0)
    normal, middle = _planes(base, vec, key, n_planes, tables, seed)
    own, visits = _buckets(normal, middle, 1), _buckets(normal, middle, probes)
    placed = settle(base.select(F.col(key).alias("base_id"), F.col(vec).alias("_vec"), F.explode(own(F.col(vec))).alias("_b")).select("base_id", "_vec", "_b.t", "_b.b"))
    visitors = settle(query.select(F.col(key).alias("_q"), F.col(vec).alias("_vec"), F.explode(visits(F.col(vec))).alias("_b")).select("_q", "_vec", "_b.t", "_b.b"))
    # large buckets in blocks, and their visitors in chunks
    sizes = placed.groupBy("t", "b").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
    calls = visitors.groupBy("t", "b").agg(F.ceil(F.count(F.lit(1)) / CHUNK_ROWS).cast("int").alias("chunks"))
    shape = sizes.join(calls, ["t", "b"])
    left = visitors.join(shape, ["t", "b"]).select(
        "_q", "_vec", "t", "b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("_q"), F.col("chunks")).cast("int").alias("chunk")
    )
    right = placed.join(shape, ["t", "b"]).select(
        "base_id", "_vec", "t", "b", F.pmod(F.xxhash64("base_id"), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")
    )
    schema = T.StructType([T.StructField("_q", query.schema[key].dataType), T.StructField("base_id", base.schema[key].dataType), T.StructField("dist", T.DoubleType())])
    most = k + others

    def best(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if q.empty or b.empty:
            return pd.DataFrame({"_q": q["_q"][:0], "base_id": b["base_id"][:0], "dist": pd.Series(dtype=float)})
        b = b.sort_values("base_id", kind="stable")
        ids, points = b["base_id"].to_numpy(), np.vstack(b["_vec"].to_numpy())
        parts = []
        for start in range(0, len(q), BATCH_ROWS):
            some = q.iloc[start : start + BATCH_ROWS]
            d = _distances(np.vstack(some["_vec"].to_numpy()), points)
            take = min(most, d.shape[1])
            order = np.argsort(d, axis=1, kind="stable")[:, :take]
            near = np.take_along_axis(d, order, axis=1).ravel()
            parts.append(pd.DataFrame({"_q": np.repeat(some["_q"].to_numpy(), take), "base_id": ids[order].ravel(), "dist": near}))
        return pd.concat(parts, ignore_index=True)

    cut = ["t", "b", "block", "chunk"]
    met = left.groupBy(*cut).cogroup(right.groupBy(*cut)).applyInPandas(best, schema)
    near = met.groupBy("_q", "base_id").agg(F.min("dist").alias("dist"))
    if others:
        near = near.filter(~F.col("_q").eqNullSafe(F.col("base_id")))
    place = F.row_number().over(Window.partitionBy("_q").orderBy("dist", "base_id"))
    return near.withColumn("place", place).filter(F.col("place") <= k).select(F.col("_q").alias(key), "base_id", "dist", "place")
