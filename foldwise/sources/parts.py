"""Feature parts: keyed column blocks stored per split, with a manifest of their feature names."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from foldwise.operators.joins import hstack


def part_path(root: str, part: str) -> str:
    return f"{root}/parts/{part}"


def save_part(df: DataFrame, root: str, part: str, key: str = "id", split_col: str = "split") -> None:
    """Writes the block by split, replacing only the splits it holds, and its manifest (part, position, feature)."""
    spark = df.sparkSession
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(split_col).parquet(part_path(root, part))
    names = [c for c in df.columns if c not in (key, split_col)]
    manifest = spark.createDataFrame([(part, i, n) for i, n in enumerate(names)], "part string, position int, feature string")
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest/part={part}")


def save_parts(parts: Mapping[str, DataFrame], root: str, key: str = "id") -> None:
    for part, df in parts.items():
        save_part(df, root, part, key)


def part_features(spark: SparkSession, root: str, part: str) -> list[str]:
    rows = spark.read.parquet(f"{root}/manifest/part={part}").orderBy("position").collect()
    return [r["feature"] for r in rows]


def load_part(spark: SparkSession, root: str, part: str, split: str | None = None, key: str = "id") -> DataFrame:
    """The block; with ``split`` only that partition is read. Columns in manifest order."""
    df = spark.read.parquet(part_path(root, part))
    names = part_features(spark, root, part)
    if split is None:
        return df.select(key, *names, "split")
    return df.filter(F.col("split") == split).select(key, *names)


def load_parts(spark: SparkSession, root: str, parts: Sequence[str], split: str, key: str = "id") -> DataFrame:
    """Several blocks side by side, aligned on the key."""
    return hstack([load_part(spark, root, p, split, key) for p in parts], key)


def to_long(df: DataFrame, key: str, cols: Sequence[str], split_col: str | None = None) -> DataFrame:
    """Sparse long form (key, feature, value) without zeros and nulls."""
    keep = [key] + ([split_col] if split_col else [])
    typed = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in cols])
    return typed.unpivot(keep, list(cols), "feature", "value").filter("value is not null and value <> 0")
