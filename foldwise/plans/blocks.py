"""Rows of numbers as blocks of bytes, for learners that read a table many times.

A row of such a table holds some thousand rows of the original one: the numbers
of a column one after another. A pass then reads whole arrays and does no work
per row outside numpy. The blocks are dealt evenly to the cores, however the
rows lay in their files.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from foldwise.session import remove_folder, shared_folder, task_count

# bytes of the widest column of one block; one row at least
BLOCK_BYTES = 1 << 20
# bytes of blocks that a reader holds at a time
GROUP_BYTES = 32 << 20


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The lists of a column as lines; every list has the same length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def stretches(n: int, width: int) -> Iterator[slice]:
    step = max(1, BLOCK_BYTES // (8 * max(1, width)))
    return (slice(a, min(n, a + step)) for a in range(0, n, step))


class Blocks:
    """Tables of blocks with the same columns, one after the other; an older one is deleted when the next is written."""

    def __init__(self, columns: Sequence[str]):
        self.columns, self.path, self.rows = list(columns), None, None

    def write(self, source: DataFrame, work: Callable[[pa.RecordBatch], Iterator[Sequence[np.ndarray]]], deal: bool = False) -> None:
        """``work`` gives the arrays of the blocks of one batch of the source."""
        names, spark = self.columns, source.sparkSession

        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    for arrays in work(batch):
                        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in arrays], names=names)

        made = source.mapInArrow(run, ", ".join(f"{c} binary" for c in names))
        if deal:
            made = made.repartition(max(task_count(spark), source.rdd.getNumPartitions()))
        path, old = shared_folder(spark, "blocks"), self.path
        made.write.option("parquet.block.size", GROUP_BYTES).parquet(path)
        self.path, self.rows = path, spark.read.schema(made.schema).parquet(path)
        if old:
            remove_folder(spark, old)

    def sums(self, work: Callable[[Iterator[tuple[bytes, ...]]], np.ndarray], size: int) -> np.ndarray:
        """The sum over the tasks of what ``work`` makes of the blocks of a task, ``size`` numbers."""
        from pyspark.sql import functions as F

        def run(batches):
            total = work(blocks_of(batches))
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["slot", "v"])

        found = self.rows.mapInArrow(run, "slot long, v double").groupBy("slot").agg(F.sum("v").alias("v")).toPandas()
        out = np.zeros(size)
        out[found["slot"].to_numpy()] = found["v"].to_numpy()
        return out

    def close(self) -> None:
        if self.path:
            remove_folder(self.rows.sparkSession, self.path)
            self.path = None

    def __enter__(self) -> "Blocks":
        return self

    def __exit__(self, *_) -> None:
        self.close()


def blocks_of(batches) -> Iterator[tuple[memoryview, ...]]:
    """The bytes of each block, column by column."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield tuple(memoryview(c[k].as_buffer()) for c in batch.columns)
