"""Order, top-k, unions, differences, samples and folds."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from foldwise.functions.hashing import hash_hex, hash_int, hash_unit
from foldwise.session import fits_broadcast, settle


def sort(df: DataFrame, keys: Sequence) -> DataFrame:
    return df.orderBy(*keys)


def numbered(df: DataFrame, out: str = "place") -> DataFrame:
    """Adds the 1-based place of each row in the order of ``df``.

    A sorted table is cut into ranges in order, so a row's place is its place in its
    range and the sizes of the ranges before; the rows are written once and not moved.
    """
    packed = F.monotonically_increasing_id()
    rows = settle(df.withColumn("_at", packed)).withColumn("_range", F.shiftright("_at", 33))
    sizes = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # one row per range
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_start"))
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    placed = rows.join(F.broadcast(starts), "_range").withColumn(out, F.col("_start") + inside + 1)
    return placed.drop("_at", "_range", "_start")


def top_k(df: DataFrame, col: str, k: int = 10) -> DataFrame:
    """The k most frequent values."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("cnt")).orderBy(F.desc("cnt"), col).limit(k)


def head(df: DataFrame, order: Sequence, n: int = 5) -> DataFrame:
    return df.orderBy(*order).limit(n)


def vstack(splits: Mapping[str, DataFrame]) -> DataFrame:
    """Union of splits with a ``split`` column."""
    return reduce(DataFrame.unionByName, [d.withColumn("split", F.lit(s)) for s, d in splits.items()])


def concat_parts(datasets: Sequence[Mapping[str, DataFrame]]) -> dict[str, DataFrame]:
    """Union part by part."""
    return {part: reduce(DataFrame.unionByName, [d[part] for d in datasets]) for part in datasets[0]}


def key_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).distinct().subtract(b.select(key).distinct())


def distinct(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct()


def holdout(df: DataFrame, key: str, frac: float = 0.22, seed=42, out: str = "split") -> DataFrame:
    """``val`` for about ``frac`` of the rows by the hash of the key, else ``train``."""
    return df.withColumn(out, F.when(hash_unit(F.col(key), seed) < frac, "val").otherwise("train"))


def _hash_order(df: DataFrame, key: str, seed) -> DataFrame:
    """Hash of the key as text, and its first four hex digits as a range of the hash order."""
    h = hash_hex(F.col(key), seed)
    return df.withColumn("_h", h).withColumn("_range", F.substring("_h", 1, 4))


def sample_exact(df: DataFrame, key: str, frac: float, seed=42) -> DataFrame:
    """Exactly ``floor(frac * n)`` rows, the first in hash order.

    Counting the 65 536 hash ranges finds the one range in which the sample
    ends; only that range is ordered.
    """
    tagged = _hash_order(df, key, seed)
    counts = {r["_range"]: r["cnt"] for r in tagged.groupBy("_range").agg(F.count(F.lit(1)).alias("cnt")).collect()}
    want = math.floor(frac * sum(counts.values()))
    taken, edge = 0, None
    for name in sorted(counts):
        if taken + counts[name] > want:
            edge = name
            break
        taken += counts[name]
    if edge is None:
        return df
    whole = tagged.filter(F.col("_range") < edge)
    part = tagged.filter(F.col("_range") == edge).orderBy("_h", key).limit(want - taken)
    return whole.unionByName(part).drop("_h", "_range")


def sample_columns(cols: Sequence[str], frac: float, seed=42) -> list[str]:
    chosen = np.random.RandomState(seed).choice(len(cols), int(len(cols) * frac), replace=False)
    return [cols[i] for i in sorted(chosen)]


def kfold(df: DataFrame, key: str, k: int, seed=2016, out: str = "fold") -> DataFrame:
    return df.withColumn(out, (hash_int(F.col(key), seed) % k).cast("int"))


def stratified_kfold(df: DataFrame, key: str, label: str, k: int, seed=2016, out: str = "fold") -> DataFrame:
    """Rows of each label dealt to the folds in hash order.

    The place of a row inside its label is the count of the hash ranges before
    plus the place inside its range, so a label that holds most rows is still
    spread over 65 536 small groups.
    """
    tagged = _hash_order(df, key, seed)
    sums = tagged.groupBy(label, "_range").agg(F.count(F.lit(1)).alias("_cnt"))
    before = Window.partitionBy(label).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = sums.select(
        F.col(label).alias("_label"),
        F.col("_range").alias("_range2"),
        F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_before"),
    )
    # at most 65 536 rows per label: measured, and broadcast if small, so that the rows move once
    shift = settle(shift)
    shift = F.broadcast(shift) if fits_broadcast(shift) else shift
    local = F.row_number().over(Window.partitionBy(label, "_range").orderBy("_h", key)) - 1
    placed = tagged.withColumn("_place", local).join(
        shift, F.col(label).eqNullSafe(F.col("_label")) & (F.col("_range") == F.col("_range2"))
    )
    fold = ((F.col("_before") + F.col("_place")) % k).cast("int")
    return placed.withColumn(out, fold).drop("_h", "_range", "_range2", "_label", "_before", "_place")


def rank_features(scores: Mapping[str, float], spark) -> DataFrame:
    """(feature, importance, place) in descending importance."""
    ordered = sorted(scores.items(), key=lambda kv: (-kv[1], kv[0]))
    rows = [(n, float(s), i + 1) for i, (n, s) in enumerate(ordered)]
    return spark.createDataFrame(rows, "feature string, importance double, place int")
