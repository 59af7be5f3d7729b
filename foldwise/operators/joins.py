"""Joins of sessions, dimensions, dictionaries and feature parts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from foldwise.operators.clean import with_sentinel_row
from foldwise.operators.skew import lookup
from foldwise.session import fits_broadcast, settle


def join_sessions(queries: DataFrame, clicks: DataFrame, plans: DataFrame, key: str = "sid", how: str = "left") -> DataFrame:
    """Queries with clicks and plans; on the left form an unmatched label becomes 0."""
    joined = queries.join(clicks, key, how).join(plans, key, how)
    if how == "left" and "click_mode" in joined.columns:
        joined = joined.withColumn("click_mode", F.coalesce("click_mode", F.lit(0)))
    return joined


def role_join(df: DataFrame, dim: DataFrame, dim_key: str, roles: Mapping[str, str], how: str = "inner") -> DataFrame:
    """Joins one dimension once per role; columns get the role as prefix."""
    dim = settle(dim)
    small = fits_broadcast(dim)
    for role, key in roles.items():
        named = dim.withColumnsRenamed({c: role + c for c in dim.columns if c != dim_key})
        named = named.withColumnRenamed(dim_key, key).withColumn("_hit", F.lit(True))
        df = lookup(df, named, [key], small=small)
        df = (df.filter("_hit") if how == "inner" else df).drop("_hit")
    return df


def left_dim(df: DataFrame, dim: DataFrame, key: str, missing=-1) -> DataFrame:
    """Dimension join in which a null key meets the sentinel row of the dimension."""
    filled = df.withColumn(key, F.coalesce(F.col(key), F.lit(missing)))
    return lookup(filled, with_sentinel_row(dim, key, missing), [key])


def agg_back(df: DataFrame, keys: Sequence[str], aggs: Mapping[str, Column]) -> DataFrame:
    """Group statistics on every detail row."""
    table = df.groupBy(*keys).agg(*[e.alias(n) for n, e in aggs.items()])
    return lookup(df, table, keys)


def keep_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key).distinct(), key, "left_semi")


def drop_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key).distinct(), key, "left_anti")


def hstack(dfs: Sequence[DataFrame], key: str, how: str = "inner") -> DataFrame:
    """Feature blocks side by side, aligned on the row id."""
    return reduce(lambda a, b: a.join(b, key, how), dfs)


def format_join(df: DataFrame, dim: DataFrame, pair: tuple[str, str], dim_key: str, fmt: str = "%.2f", how: str = "left") -> DataFrame:
    """Joins on text built from two doubles, such as ``116.31,40.07``."""
    keyed = df.withColumn(dim_key, F.format_string(f"{fmt},{fmt}", *pair))
    hit = lookup(keyed, dim.withColumn("_hit", F.lit(True)), [dim_key])
    return (hit.filter("_hit") if how == "inner" else hit).drop("_hit")
