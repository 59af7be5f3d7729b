"""Reading tables with explicit schemas and column roles; writing csv and libsvm."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# fixed values: schemas of the input tables
QUERY_SCHEMA = "sid bigint, pid double, req_time timestamp, o string, d string"
PLAN_SCHEMA = "sid bigint, plan_time timestamp, plans string"
CLICK_SCHEMA = "sid bigint, click_time timestamp, click_mode int"
PROFILE_SCHEMA = "pid double, " + ", ".join(f"p{i} double" for i in range(66))
ADDRESS_SCHEMA = "adcode string, district string, lntlat string, street string, street_number string"
CLAIM_SCHEMA = (
    "id bigint, " + ", ".join(f"cat{i} string" for i in range(1, 117)) + ", "
    + ", ".join(f"cont{i} double" for i in range(1, 15)) + ", loss double"
)


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, **options) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, escape='"', **options)


def read_tables(spark: SparkSession, folder: str, schemas: Mapping[str, str], fmt: str = "csv") -> dict[str, DataFrame]:
    """One DataFrame per name from ``<folder>/<name>.<fmt>`` (a file or a folder)."""
    if fmt == "csv":
        return {n: read_csv(spark, f"{folder}/{n}.csv", s) for n, s in schemas.items()}
    return {n: spark.read.schema(s).format(fmt).load(f"{folder}/{n}.{fmt}") for n, s in schemas.items()}


# fixed values: column roles by name prefix
ROLES = {"cat": "cat", "num": "num", "cont": "num", "svd": "svd"}


def roles(df: DataFrame) -> dict[str, list[str]]:
    """Columns per role, taken from the training table and reused for the others."""
    found: dict[str, list[str]] = {r: [] for r in dict.fromkeys(ROLES.values())}
    for c in df.columns:
        for prefix, role in ROLES.items():
            if c.startswith(prefix):
                found[role].append(c)
                break
    return found


def select_roles(df: DataFrame, chosen: Mapping[str, Sequence[str]], keep: Sequence[str]) -> DataFrame:
    """The given columns only; numbers as double, categories as text."""
    cats = [F.col(c).cast("string").alias(c) for c in chosen.get("cat", [])]
    nums = [F.col(c).cast("double").alias(c) for r in ("num", "svd") for c in chosen.get(r, [])]
    return df.select(*keep, *cats, *nums)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"')


def write_libsvm(df: DataFrame, path: str, label: str, features: str, shift: int = 0, seed: int | None = 42) -> None:
    """``label idx:value`` lines in random order; ``shift`` is added to the label."""
    rows = df.select((F.col(label) + shift).cast("double").alias("label"), F.col(features).alias("features"))
    if seed is not None:
        # order inside and between files: range partitions of a seeded random number
        rows = rows.withColumn("_r", F.rand(seed)).repartitionByRange("_r").sortWithinPartitions("_r").drop("_r")
    rows.write.mode("overwrite").format("libsvm").save(path)
