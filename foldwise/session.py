"""Session helpers: the shared folder, and data whose size is known."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# A dictionary below both bounds may be broadcast; anything larger is shuffled.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 * 1024 * 1024


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a local one only where none is set."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="foldwise-"))
    return context.getCheckpointDir()


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Compute once into a table in the shared folder and go on from there.

    Cuts the lineage, survives executor loss, and gives the optimizer the real size. ``compression`` for large tables of
    text keys, which the usual codec hardly shortens.
    """
    spark = df.sparkSession
    path = shared_folder(spark, "table")
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def own_session(spark: SparkSession, settings: dict[str, str]) -> SparkSession:
    """A session on the same context that keeps the settings of ``spark`` and adds some; ``spark`` stays as it is.

    For a table that has to be written in another way than others. A setting that ``spark`` has already is left to it.
    """
    own = spark.newSession()
    for name, value in {**settings, **spark.conf.getAll}.items():
        if not name.startswith("spark.") or spark.conf.isModifiable(name):
            own.conf.set(name, value)
    return own


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def paths_like(spark: SparkSession, pattern: str) -> list[str]:
    """The files and folders that match a pattern, in whatever store the path names."""
    store, place = _file_system(spark, pattern)
    return [status.getPath().toString() for status in store.globStatus(place) or []]


def remove_folder(spark: SparkSession, path: str) -> None:
    store, place = _file_system(spark, path)
    store.delete(place, True)


@contextmanager
def settled(df: DataFrame, compression: str | None = None) -> Iterator[DataFrame]:
    """``settle`` for work that ends inside the block: the table is deleted afterwards, also after a failure."""
    spark = df.sparkSession
    path = shared_folder(spark, "table")
    try:
        df.write.parquet(path, compression=compression)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        remove_folder(spark, path)


def row_width(df: DataFrame) -> Column:
    """Bytes of a row, about."""
    numeric_bytes = 16 * len(df.columns)
    text = [
        F.coalesce(F.length(c), F.lit(0))
        for c, t in df.dtypes
        if t == "string"
    ]
    return sum(text, F.lit(numeric_bytes))


def fits_broadcast(df: DataFrame) -> bool:
    """True when a measured row count and text size are inside the broadcast bounds."""
    rows, size = df.agg(F.count(F.lit(1)), F.sum(row_width(df))).first()
    return rows <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES


def task_count(spark: SparkSession) -> int:
    """How many pieces the work of one operator should be cut into."""
    return max(
        int(spark.conf.get("spark.sql.shuffle.partitions", "200")),
        spark.sparkContext.defaultParallelism,
    )


def spread(df: DataFrame) -> DataFrame:
    """Deals a scan to all cores if it has fewer splits than cores, or if a few splits hold most of its rows.

    Fewer splits than cores means less than one split of data per core, so the
    shuffle is small. A file of few row groups gives few splits with rows,
    however many splits it is cut into, so the rows of each split are counted (from the footers).
    A table whose splits are even stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    sizes = df.groupBy(F.spark_partition_id().alias("_split")).agg(F.count(F.lit(1)).alias("n"))
    most, rows = sizes.agg(F.max("n"), F.sum("n")).first()
    return deal(df) if rows and most * cores > 2 * rows else df


def deal(df: DataFrame) -> DataFrame:
    """Deals rows evenly to all cores, for tables that a learner reads many times.

    A file of few row groups gives few splits with rows, however many splits it is cut into.
    """
    return df.repartition(max(task_count(df.sparkSession), df.rdd.getNumPartitions()))


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers once, so that functions run from any working directory."""
    context = spark.sparkContext
    if getattr(context, "_foldwise_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="foldwise-code-"), "foldwise.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as bundle:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    bundle.write(path, os.path.join("foldwise", os.path.relpath(path, root)))
    context.addPyFile(archive)
    context._foldwise_shipped = True
