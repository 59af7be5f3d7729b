"""Named queries, each with the SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def r6(*cols: str):
    """Columns rounded to six places (float sums differ in the last bits between engines)."""
    from pyspark.sql import functions as F

    return [F.round(F.col(f"`{c}`").cast("double"), 6).alias(c) for c in cols]
