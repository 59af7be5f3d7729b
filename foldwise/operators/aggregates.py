"""Group-bys: counts, moments, arg-extremes, medians, pivots."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from foldwise.operators.ordering import ordered_counts, ordered_counts_many, quantiles_of
from foldwise.operators.skew import lookup
from foldwise.session import settle


def unpivot(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = (), as_type: str = "string") -> DataFrame:
    """(keep, feature, value): one row per row and column, nulls included."""
    typed = df.select(*keep, *[F.col(c).cast(as_type).alias(c) for c in cols])
    return typed.unpivot([*keep], list(cols), "feature", "value")


def frequencies(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, feature, value, cnt) of all columns in one pass."""
    return unpivot(df, cols, by).groupBy(*by, "feature", "value").agg(F.count(F.lit(1)).alias("cnt"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("cnt")).orderBy(F.desc("cnt"), col)


def nunique(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct non-null values per column: one count of pre-aggregated pairs."""
    pairs = unpivot(df, cols).filter("value is not null").groupBy("feature", "value").agg(F.lit(1).alias("_one"))
    return pairs.groupBy("feature").agg(F.count(F.lit(1)).alias("n_distinct"))


def column_table(df: DataFrame, cols: Sequence[str], facts: Mapping[str, object], as_type: str = "double") -> DataFrame:
    """(feature, fact...) from one wide aggregation: no row is multiplied by the number of columns."""
    one = df.agg(
        *[
            F.struct(F.lit(c).alias("feature"), *[f(F.col(c).cast(as_type)).alias(n) for n, f in facts.items()]).alias(f"_{i}")
            for i, c in enumerate(cols)
        ]
    )
    return one.select(F.inline(F.array(*[f"_{i}" for i in range(len(cols))])))


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """count, mean, sample std, min, exact quartiles, max per column."""
    base = column_table(
        df, cols, {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    )
    quartiles = quantiles_of(ordered_counts_many(df, cols), [0.25, 0.5, 0.75], ["feature"])
    named = quartiles.withColumnsRenamed({"q0": "q25", "q1": "q50", "q2": "q75"})
    return base.join(F.broadcast(named), "feature", "left")  # one row per column


def null_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, n_null) per column."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return one.unpivot([], list(cols), "feature", "n_null")


def group_stats(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """max, min, mean, population std of every column per group."""
    forms = {"max": F.max, "min": F.min, "mean": F.avg, "std": F.stddev_pop}
    return df.groupBy(*keys).agg(*[f(c).alias(f"{n}_{c}") for c in cols for n, f in forms.items()])


def extreme(value: Column, position: Sequence[Column], out: Column, largest: bool, ties: str = "edge") -> Column:
    """Aggregate: ``out`` at the smallest or largest value; a null value is never an extreme.

    Ties: ``edge`` takes the first position for the smallest and the last one
    for the largest; ``first`` takes the first position for both.
    """
    if largest and ties == "first":
        position = [-p for p in position]
    fields = [value.alias("v"), *[p.alias(f"p{i}") for i, p in enumerate(position)], out.alias("out")]
    known = F.when(value.isNotNull(), F.struct(*fields))
    return (F.max(known) if largest else F.min(known))["out"]


def arg_extreme(
    df: DataFrame, keys: Sequence[str], values: Sequence[str], position: Sequence[str], out: str, ties: str = "edge"
) -> DataFrame:
    """Per group, ``out`` of the row with the smallest and of the row with the largest value."""
    place = [F.col(p) for p in position]
    aggs = []
    for v in values:
        aggs.append(extreme(F.col(v), place, F.col(out), True, ties).alias(f"max_{v}_{out}"))
        aggs.append(extreme(F.col(v), place, F.col(out), False, ties).alias(f"min_{v}_{out}"))
    return df.groupBy(*keys).agg(*aggs)


def first_by(df: DataFrame, keys: Sequence[str], position: Sequence[str], col: str, out: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min_by(col, F.struct(*position)).alias(out))


def multi_hot(df: DataFrame, keys: Sequence[str], col: str, n: int, prefix: str = "mode_feas_") -> DataFrame:
    """n flags per group: does the class occur in it? A group of only nulls sets flag 0."""
    flags = [F.coalesce(F.max((F.col(col) == i).cast("int")), F.lit(0)).alias(f"{prefix}{i}") for i in range(n)]
    empty = F.count(col) == 0
    grouped = df.groupBy(*keys).agg(empty.alias("_empty"), *flags)
    return grouped.withColumn(f"{prefix}0", F.when(F.col("_empty"), 1).otherwise(F.col(f"{prefix}0"))).drop("_empty")


def grouped_median(df: DataFrame, keys: Sequence[str], col: str, out: str = "median") -> DataFrame:
    """Exact median per group, nulls skipped; a large group is spread over value ranges."""
    return quantiles_of(ordered_counts(df, col, keys), [0.5], keys).withColumnRenamed("q0", out)


def impute_group_median(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """Nulls of ``col`` replaced by the median of their group."""
    filled = lookup(df, grouped_median(df, keys, col, "_median"), keys)
    return filled.withColumn(col, F.coalesce(F.col(col).cast("double"), F.col("_median"))).drop("_median")


def ratio_of_means(df: DataFrame, keys: Sequence[str], num: str, den: str, out: str = "ratio") -> DataFrame:
    return df.groupBy(*keys).agg((F.avg(num) / F.nullif(F.avg(den), F.lit(0.0))).alias(out))


def pivot_mean(df: DataFrame, key: str, col: str, val: str, values: Sequence) -> DataFrame:
    return df.groupBy(key).pivot(col, list(values)).agg(F.avg(val))


def share_of_total(df: DataFrame, keys: Sequence[str], within: str) -> DataFrame:
    """(keys, within, cnt, total, share): counts per value against the total of the group."""
    counts = df.groupBy(*keys, within).agg(F.count(F.lit(1)).alias("cnt"))
    counts = settle(counts)
    totals = counts.groupBy(*keys).agg(F.sum("cnt").alias("total"))
    return lookup(counts, totals, keys).withColumn("share", F.col("cnt") / F.col("total"))


def repeat_counts(shares: DataFrame, thresholds: Sequence[int] = (3, 4, 5)) -> DataFrame:
    """How many group values of busy groups repeat, per threshold on the group total."""
    aggs = []
    for t in thresholds:
        busy = F.col("total") > t
        aggs.append(F.count_if(busy & (F.col("cnt") > 1)).alias(f"repeated_over_{t}"))
        aggs.append(F.count_if(busy & (F.col("cnt") <= 1)).alias(f"single_over_{t}"))
    return shares.agg(*aggs)


def contains_flag(df: DataFrame, keys: Sequence[str], col: str, value, out: str = "contains") -> DataFrame:
    """1 if the group holds the value, else -1."""
    hit = F.max(F.when(F.col(col) == value, 1).otherwise(-1))
    return df.groupBy(*keys).agg(hit.alias(out))


def group_size(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))


def label_mix(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """(profile, p_value, label, mode_counts) for many columns in one pass."""
    long = unpivot(df, cols, [label], "double").filter("value is not null")
    counts = long.groupBy("feature", "value", label).agg(F.count(F.lit(1)).alias("mode_counts"))
    return counts.withColumnsRenamed({"feature": "profile", "value": "p_value"})


def label_mix_ratio(mix: DataFrame, label: str, inside=0) -> DataFrame:
    """Per column: rows with value 0 over rows with value 1, overall and within one label."""
    def total(value, extra=F.lit(True)):
        return F.sum(F.when((F.col("p_value") == value) & extra, F.col("mode_counts")))

    only = F.col(label) == inside
    return mix.groupBy("profile").agg(
        (total(0) / F.nullif(total(1), F.lit(0))).alias("ratio_all"),
        (total(0, only) / F.nullif(total(1, only), F.lit(0))).alias("ratio_inside"),
    )


def moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, mean, std, min, max) with the population std, in one pass."""
    return column_table(df, cols, {"mean": F.avg, "std": F.stddev_pop, "min": F.min, "max": F.max})


def column_facts(df: DataFrame, cols: Sequence[str], facts: Mapping[str, object]) -> dict:
    """One aggregation over all columns; {column: {fact: value}} for fitted encoders."""
    row = df.agg(*[f(F.col(c).cast("double")).alias(f"{n}|{c}") for c in cols for n, f in facts.items()]).first()
    return {c: {n: row[f"{n}|{c}"] for n in facts} for c in cols}


def skew(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, skewness), population form."""
    return column_table(df, cols, {"skewness": F.skewness})


def quantile_edges(df: DataFrame, col: str, qs: Sequence[float]) -> DataFrame:
    """One row q0..qn of exact interpolated quantiles."""
    return quantiles_of(ordered_counts(df, col), qs)


def dedupe(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: str = "first") -> DataFrame:
    """One row per key by explicit order; partially aggregated, so a heavy key costs no sort."""
    pick = F.min_by if keep == "first" else F.max_by
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def target_stats(df: DataFrame, cols: Sequence[str], target: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, feature, value, target_sum, cnt) of all columns in one pass."""
    long = unpivot(df, cols, [*by, target])
    return long.groupBy(*by, "feature", "value").agg(F.sum(target).alias("target_sum"), F.count(target).alias("cnt"))
