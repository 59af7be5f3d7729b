"""Prediction tables: written per run and part, read back singly, averaged or raised to a power."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from foldwise.session import paths_like

# fixed values: the three parts of a run
PARTS = ("train", "test-foldavg", "test-fulltrain")


def run_path(root: str, run: str, part: str) -> str:
    return f"{root}/predictions/run={run}/part={part}"


def save_predictions(df: DataFrame, root: str, run: str, part: str) -> None:
    """(key, value) or (key, class columns) of one part of a run; the run name carries the score."""
    df.write.mode("overwrite").parquet(run_path(root, run, part), compression="zstd")


def _one(spark: SparkSession, root: str, run: str, part: str, mode: str) -> DataFrame:
    if part == "test":
        path = run_path(root, run, f"test-{mode}")
        if paths_like(spark, path):
            return spark.read.parquet(path)
    return spark.read.parquet(run_path(root, run, part))


def value_columns(df: DataFrame, key: str) -> list[str]:
    """The value column, or the class columns in their order, of a prediction table."""
    return [c for c in df.columns if c != key]


def load_prediction(spark: SparkSession, root: str, spec, part: str, mode: str = "fulltrain", key: str = "id") -> DataFrame:
    """A run name; a list of specs (plain mean, column by column); or (spec, {"power": p}).

    The table keeps the columns it was saved with: one value, or one column per class.
    """
    if isinstance(spec, tuple):
        inner, options = spec
        rows = load_prediction(spark, root, inner, part, mode, key)
        if "power" in options:
            power = F.lit(float(options["power"]))
            rows = rows.select(key, *[F.pow(c, power).alias(c) for c in value_columns(rows, key)])
        return rows
    if isinstance(spec, list):
        each = [load_prediction(spark, root, s, part, mode, key) for s in spec]
        union = reduce(DataFrame.unionByName, each)
        return union.groupBy(key).agg(*[(F.sum(c) / F.lit(len(spec))).alias(c) for c in value_columns(union, key)])
    return _one(spark, root, spec, part, mode)


def find_run(spark: SparkSession, root: str, preset: str) -> str:
    """The name of the last run of a preset, ``<time>-<preset>-<score>``; the times sort as text."""
    found = [re.search(r"run=([^/]+)/?$", p)[1] for p in paths_like(spark, f"{root}/predictions/run=*-{preset}-*")]
    exact = sorted(r for r in found if re.fullmatch(rf"\d{{8}}-\d{{4}}-{re.escape(preset)}-[\d.]+", r))
    if not exact:
        raise LookupError(f"no run of {preset}")
    return exact[-1]
