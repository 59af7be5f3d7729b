"""History inside ordered groups; heavy groups are cut into segments."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from foldwise.operators.joins import agg_back
from foldwise.operators.ordering import average_rank_of, ordered_counts_many
from foldwise.operators.skew import HEAVY_ROWS, OrderedGroups, join_null_safe, lookup


def lag_by(df, keys, order, col, out, default=None, min_rows=HEAVY_ROWS, pieces=None) -> DataFrame:
    """Previous value in the group; no previous row (or a null value) gives ``default``."""
    done = OrderedGroups(df, keys, order, min_rows, pieces).lag({out: col}).result()
    return done if default is None else done.withColumn(out, F.coalesce(F.col(out), F.lit(default)))


def history_list(df, keys, order, col, out="history", max_len=None, min_rows=HEAVY_ROWS, pieces=None, sep=None) -> DataFrame:
    """Values of all earlier rows, oldest first; only the last ``max_len`` where a length is given.

    With ``sep`` the values come as one text, joined by it, without nulls. A list of the whole past in every row is quadratic in the group; shares and counts
    over the whole history come from ``history_share`` without building lists.
    """
    groups = OrderedGroups(df, keys, order, min_rows, pieces)
    if max_len is None:
        return groups.whole_past(out, col, sep).result()
    done = groups.last_values(out, col, max_len).result()
    return done if sep is None else done.withColumn(out, F.array_join(F.transform(out, lambda v: v.cast("string")), sep))


def class_names(prefix: str, n: int) -> list[str]:
    return [f"{prefix}{i}" for i in range(n)]


def history_share(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    col: str,
    n: int,
    stop=-1,
    prefix: str = "mode_num_",
    min_rows: int = HEAVY_ROWS,
    pieces: int | None = None,
    groups: OrderedGroups | None = None,
) -> OrderedGroups:
    """Share of each class among the earlier values, up to the first ``stop`` value; no history gives zeros."""
    groups = groups or OrderedGroups(df, keys, order, min_rows, pieces)
    groups.before_first("_open", F.col(col) == stop)
    groups.running_sum({f"_n_{prefix}{i}": (F.col(col) == i) & F.col("_open") for i in range(n)})
    names = class_names(prefix, n)
    total = sum((F.col(f"_n_{c}") for c in names), F.lit(0))
    groups.df = groups.df.withColumn("_total", total)
    shares = {c: F.when(F.col("_total") > 0, F.col(f"_n_{c}") / F.col("_total")).otherwise(F.lit(0.0)) for c in names}
    groups.df = groups.df.withColumns(shares).drop("_open", "_total", *[f"_n_{c}" for c in names])
    return groups


def most_frequent(prefix: str, n: int, none=0) -> Column:
    """Class with the largest share (the smallest class on ties); no history gives ``none``."""
    values = F.array(*class_names(prefix, n))
    best = F.array_max(values)
    return F.when(best > 0, (F.array_position(values, best) - 1).cast("int")).otherwise(F.lit(none))


def history_mode(df, keys, order, col, n, stop=-1, out="max_mode", none=0, min_rows=HEAVY_ROWS, pieces=None) -> DataFrame:
    groups = history_share(df, keys, order, col, n, stop, "_share_", min_rows, pieces)
    done = groups.result().withColumn(out, most_frequent("_share_", n, none))
    return done.drop(*class_names("_share_", n))


def since_previous(df, keys, ts, tie=(), min_rows=HEAVY_ROWS, pieces=None) -> DataFrame:
    """Previous time (the first row of a group takes the earliest time of the table), seconds since, its weekday and hour."""
    done = OrderedGroups(df, keys, [ts, *tie], min_rows, pieces).lag({"last_time": ts}).result()
    return with_time_since(done, ts)


def with_time_since(df: DataFrame, ts: str) -> DataFrame:
    filled = df.withColumn("last_time", F.coalesce("last_time", df.agg(F.min(ts)).scalar()))
    return filled.withColumns(
        {
            "since_last": F.unix_timestamp(ts) - F.unix_timestamp("last_time"),
            "last_weekday": F.weekday("last_time"),
            "last_hour": F.hour("last_time"),
        }
    )


def running_counts(df, keys, ts, col, n, prefix="till_now_", min_rows=HEAVY_ROWS, pieces=None) -> DataFrame:
    """Counts of each class among rows of the group with a time up to and including the current one.

    Rows of one time are counted together first, so equal times see each other.
    """
    names = class_names(prefix, n)
    per_time = df.groupBy(*keys, ts).agg(*[F.count_if(F.col(col) == i).alias(f"_{c}") for i, c in enumerate(names)])
    groups = OrderedGroups(per_time, keys, [ts], min_rows, pieces)
    groups.running_sum({c: F.col(f"_{c}") for c in names}, inclusive=True)
    table = groups.result().select(*keys, ts, *names)
    return lookup(df, table, [*keys, ts], small=False)


def list_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str], out="rank", min_rows=HEAVY_ROWS, pieces=None) -> DataFrame:
    """1-based place in the ordered group."""
    groups = OrderedGroups(df, keys, order, min_rows, pieces)
    return groups.running_sum({out: F.lit(1)}, inclusive=True).result()


def average_rank(df: DataFrame, cols: Sequence[str], key: str) -> DataFrame:
    """(key, feature, value, rank): mean rank on ties, per column over the whole table."""
    ranks = average_rank_of(ordered_counts_many(df, cols)).select("feature", "value", "rank")
    long = df.select(key, *[F.col(c).cast("double").alias(c) for c in cols])
    long = long.unpivot([key], list(cols), "feature", "value").filter("value is not null")
    return lookup(long, ranks, ["feature", "value"], spread=[key])


def transform_agg(df: DataFrame, keys: Sequence[str], aggs: Mapping[str, Column]) -> DataFrame:
    """Group aggregates as columns of every row."""
    return agg_back(df, keys, aggs)
