"""Exact ranks, quantiles and medians without sorting everything in one task.

Equal values are collapsed first (a value that fills a third of the table is
one row afterwards), the distinct values are cut into ranges at fixed cut
points, counted inside each range, and shifted by the totals of the ranges
before. Cut points are approximate quantiles; they steer the balance only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from foldwise.session import task_count


def _cut_points(df: DataFrame, cols: Sequence[str], pieces: int | None) -> list[list[float]]:
    pieces = pieces or task_count(df.sparkSession)
    if pieces < 2:
        return [[] for _ in cols]
    probabilities = [i / pieces for i in range(1, pieces)]
    found = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).approxQuantile(
        list(cols), probabilities, 0.5 / pieces
    )
    return [sorted(set(f)) for f in found]


def _range_of(df: DataFrame, cols: Sequence[str], outs: Sequence[str], cuts: list[list[float]]) -> DataFrame:
    for c, o, cut in zip(cols, outs, cuts):
        if not cut:
            df = df.withColumn(o, F.lit(0.0))
            continue
        splits = [float("-inf"), *cut, float("inf")]
        df = Bucketizer(splits=splits, inputCol=c, outputCol=o, handleInvalid="keep").transform(df)
    return df


def _accumulate(counts: DataFrame, keys: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """(keys, value, _range, cnt) -> adds ``before`` (count below the value) and ``total`` per key."""
    inside = Window.partitionBy(*keys, "_range").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    local = counts.withColumn("_below", F.coalesce(F.sum("cnt").over(inside), F.lit(0)))
    sums = counts.groupBy(*keys, "_range").agg(F.sum("cnt").alias("_sum"))
    # one row per range here, so this window is small even without a partition key
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = sums.select(
        *keys,
        "_range",
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_shift"),
        F.sum("_sum").over(whole).alias("total"),
    )
    if not keys:
        shift = F.broadcast(shift)
    joined = local.join(shift, [*keys, "_range"])
    return joined.select(*keys, "value", "cnt", (F.col("_below") + F.col("_shift")).alias("before"), "total", *extra)


def ordered_counts(
    df: DataFrame,
    value: str,
    keys: Sequence[str] = (),
    weight: Column | None = None,
    pieces: int | None = None,
    extra: dict[str, Column] | None = None,
) -> DataFrame:
    """Per key: every distinct non-null value with its count (or weight), the count below it and the total.

    ``extra`` names further aggregates of the rows of one value.
    """
    keys, extra = list(keys), extra or {}
    rows = df.withColumn("value", F.col(value).cast("double")).filter(F.col("value").isNotNull())
    cuts = _cut_points(rows, ["value"], pieces)
    amount = F.sum(weight) if weight is not None else F.count(F.lit(1))
    counts = rows.groupBy(*keys, "value").agg(amount.alias("cnt"), *[e.alias(n) for n, e in extra.items()])
    return _accumulate(_range_of(counts, ["value"], ["_range"], cuts), keys, list(extra))


def ordered_counts_many(df: DataFrame, cols: Sequence[str], pieces: int | None = None) -> DataFrame:
    """``ordered_counts`` of several columns in one pass: (feature, value, cnt, before, total)."""
    cols = list(cols)
    wide = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    cuts = _cut_points(wide, cols, pieces)
    ranged = _range_of(wide, cols, [f"_range_{c}" for c in cols], cuts)
    pairs = ", ".join(f"'{c}', `{c}`, `_range_{c}`" for c in cols)
    long = ranged.selectExpr(f"stack({len(cols)}, {pairs}) as (feature, value, _range)").filter("value is not null")
    counts = long.groupBy("feature", "value", "_range").agg(F.count(F.lit(1)).alias("cnt"))
    return _accumulate(counts, ["feature"])


def quantiles_of(counts: DataFrame, qs: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Linear-interpolation quantiles (keys, q0..qn) from an ``ordered_counts`` table."""
    aggs = []
    for i, q in enumerate(qs):
        place = F.lit(float(q)) * (F.col("total") - 1)
        for side, rank in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            here = (F.col("before") <= rank) & (rank < F.col("before") + F.col("cnt"))
            aggs.append(F.max(F.when(here, F.col("value"))).alias(f"_{side}{i}"))
    grouped = counts.groupBy(*keys).agg(F.max("total").alias("_total"), *aggs)
    out = []
    for i, q in enumerate(qs):
        place = F.lit(float(q)) * (F.col("_total") - 1)
        step = (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (place - F.floor(place))
        out.append((F.col(f"_lo{i}") + step).alias(f"q{i}"))
    return grouped.select(*keys, *out)


def average_rank_of(counts: DataFrame) -> DataFrame:
    """Adds ``rank``: the mean 1-based rank of all rows that share the value."""
    return counts.withColumn("rank", F.col("before") + (F.col("cnt") + 1) / F.lit(2.0))
