"""Products with sparse rows, and the leading singular vectors found with them.

No row is made dense beyond ``NARROW`` columns: a vector travels as its stored places and values. A null
vector adds nothing to a sum and has a null product.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from foldwise.session import settled, ship_package

# numbers of one temporary product in a task
STEP = 1 << 21
# columns of one partial sum that travels to be added up
SLOT = 1 << 10
# bound of the block of vectors that every task holds; one vector at least
BLOCK_BYTES = 64 * 1024 * 1024
# up to this width the whole Gram matrix is one pass
NARROW = 256
# vectors beyond the asked ones, which speed up convergence
EXTRA = 8


def places(vector: Column) -> Column:
    """The stored places of a vector, dense vectors included."""
    raw = F.unwrap_udt(vector)
    return F.when(raw["type"] == 0, raw["indices"]).otherwise(F.transform(raw["values"], lambda v, i: i))


def values(vector: Column) -> Column:
    return F.unwrap_udt(vector)["values"]


def total(vector: Column) -> Column:
    """The sum of the entries, whatever the width."""
    return F.aggregate(values(vector), F.lit(0.0), lambda a, x: a + x)


def width(vector: Column) -> Column:
    raw = F.unwrap_udt(vector)
    return F.coalesce(raw["size"], F.size(raw["values"]))


def _stretches(lengths: np.ndarray, most: int):
    """Row ranges of at most ``most`` entries, or one row, with the bounds of their entries."""
    ends = np.append(0, np.cumsum(lengths))
    start = 0
    while start < len(lengths):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + most, side="right")) - 1)
        yield start, stop, int(ends[start]), int(ends[stop])
        start = stop


def row_products(at: np.ndarray, value: np.ndarray, lengths: np.ndarray, block: np.ndarray) -> np.ndarray:
    """``X B``, one line per row."""
    if len(lengths) and (lengths == len(block)).all():
        return value.reshape(len(lengths), -1) @ block
    out = np.zeros((len(lengths), block.shape[1]))
    for a, z, i, j in _stretches(lengths, max(1, STEP // block.shape[1])):
        some = np.flatnonzero(lengths[a:z])
        if len(some):
            starts = (np.cumsum(lengths[a:z]) - lengths[a:z])[some]
            out[a + some] = np.add.reduceat(value[i:j, None] * block[at[i:j]], starts, axis=0)
    return out


def add_products(total: np.ndarray, at: np.ndarray, value: np.ndarray, lengths: np.ndarray, products: np.ndarray) -> None:
    """Adds ``X' P`` to the total."""
    if len(lengths) and (lengths == len(total)).all():
        total += value.reshape(len(lengths), -1).T @ products
        return
    for a, z, i, j in _stretches(lengths, max(1, STEP // total.shape[1])):
        order = np.argsort(at[i:j], kind="stable")
        columns, starts = np.unique(at[i:j][order], return_index=True)
        if len(columns):
            row = np.repeat(np.arange(a, z), lengths[a:z])[order]
            total[columns] += np.add.reduceat(value[i:j][order, None] * products[row], starts, axis=0)


def add_narrow(total: np.ndarray, at: np.ndarray, value: np.ndarray, lengths: np.ndarray, block: np.ndarray) -> None:
    """Adds ``X'(X B)`` for few columns, where matrix products of some filled rows at a time cost less than sorting entries."""
    for a, z, i, j in _stretches(lengths, max(1, STEP // len(total))):
        filled = np.zeros((z - a, len(total)))
        filled[np.repeat(np.arange(z - a), lengths[a:z]), at[i:j]] = value[i:j]
        total += filled.T @ (filled @ block)


def _read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at, value = batch.column("at"), batch.column("value")
    lengths = pc.fill_null(pc.list_value_length(value), 0).to_numpy(zero_copy_only=False)
    return at.flatten().to_numpy(zero_copy_only=False), value.flatten().to_numpy(zero_copy_only=False), lengths


def gram_times(rows: DataFrame, block: np.ndarray) -> np.ndarray:
    """``X'(X B)`` for rows (at, value).

    Each task adds up its rows and hands on the columns it met, cut into slots; the number of
    tasks follows the cores, not the data, so what travels does not grow with the rows.
    """
    spark = rows.sparkSession
    ship_package(spark)
    cores = spark.sparkContext.defaultParallelism
    held = spark.sparkContext.broadcast(block)
    slots = -(-len(block) // SLOT)

    def partial(batches):
        vectors = held.value
        total, met = np.zeros(vectors.shape), np.zeros(len(vectors), bool)
        for batch in batches:
            at, value, lengths = _read(batch)
            if len(vectors) <= NARROW:
                add_narrow(total, at, value, lengths, vectors)
            else:
                add_products(total, at, value, lengths, row_products(at, value, lengths, vectors))
            met[at] = True
        columns = np.flatnonzero(met)
        for some in np.split(columns, np.flatnonzero(np.diff(columns // SLOT)) + 1):
            if len(some):
                yield _part(some, total[some])

    def added(batches):
        sums: dict[int, np.ndarray] = {}
        met: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, columns, part in _parts(*batch.columns):
                slot = int(columns[0]) // SLOT
                if slot not in sums:
                    sums[slot], met[slot] = np.zeros((SLOT, part.shape[1])), np.zeros(SLOT, bool)
                sums[slot][columns % SLOT] += part
                met[slot][columns % SLOT] = True
        for slot, total in sums.items():
            columns = np.flatnonzero(met[slot])
            yield _part(columns + slot * SLOT, total[columns])

    shape = "slot int, columns binary, part binary"
    parts = rows.coalesce(3 * cores).mapInArrow(partial, shape)
    found = parts.repartition(min(slots, cores), "slot").mapInArrow(added, shape).toArrow()
    held.unpersist()
    out = np.zeros(block.shape)
    for _, columns, part in _parts(*found.columns):
        out[columns] = part
    return out


def _part(columns: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    """One row: the slot, its columns, and their sums."""
    cells = [pa.array([int(columns[0]) // SLOT], pa.int32()), pa.array([columns.tobytes()]), pa.array([sums.tobytes()])]
    return pa.RecordBatch.from_arrays(cells, names=["slot", "columns", "part"])


def _parts(slot, columns, part):
    for s, c, p in zip(slot, columns, part):
        c = np.frombuffer(c.as_py(), np.int64)
        yield s.as_py(), c, np.frombuffer(p.as_py()).reshape(len(c), -1)


def _fresh(rest: np.ndarray, basis: np.ndarray, least: float) -> np.ndarray:
    """An orthonormal block for what the columns hold outside the basis; fewer columns where there is less."""
    for _ in range(2):
        rest = rest - basis @ (basis.T @ rest)
    u, s, _ = np.linalg.svd(rest, full_matrices=False)
    u = u[:, s > least]
    if not u.shape[1]:
        return u
    u = u - basis @ (basis.T @ u)
    return np.linalg.qr(u)[0]


def leading(
    rows: DataFrame, columns: int, k: int, seed: int = 42, tolerance: float = 1e-9, passes: int = 200
) -> tuple[np.ndarray, np.ndarray, float]:
    """The ``k`` leading right singular vectors of rows (at, value), singular values, and the residual.

    Block Lanczos with thick restart: each pass over the rows multiplies one block by the Gram matrix. It ends
    when ``|G v - s^2 v|`` is at most ``tolerance`` times the largest ``s^2`` for all k, and warns if it never is.
    The driver holds a few times k vectors of the width, the tasks one block of at most ``BLOCK_BYTES``.
    Singular values come from their squares: those below 1e-7 of the largest are noise.
    """
    k = min(k, columns)
    draw = np.random.RandomState(seed)
    if columns <= NARROW:
        block = np.eye(columns)
    else:
        size = min(columns, k + EXTRA, max(1, BLOCK_BYTES // (8 * columns)))
        block = np.linalg.qr(draw.normal(size=(columns, size)))[0]
    size = block.shape[1]
    most = max(4 * (k + EXTRA), k + EXTRA + 2 * size)
    basis, images = np.zeros((columns, 0)), np.zeros((columns, 0))
    worst = np.inf
    for _ in range(passes):
        image = gram_times(rows, block)
        basis, images = np.hstack([basis, block]), np.hstack([images, image])
        small = basis.T @ images
        square, turn = np.linalg.eigh((small + small.T) / 2)
        square, turn = square[::-1], turn[:, ::-1]
        scale = max(square[0], np.finfo(float).tiny)
        if basis.shape[1] >= k:
            top = turn[:, :k]
            worst = float(np.linalg.norm(images @ top - basis @ top * square[:k], axis=0).max() / scale)
            if worst <= tolerance or basis.shape[1] >= columns:
                break
        block = _fresh(image, basis, 1e-13 * scale)
        if not block.shape[1]:
            block = _fresh(draw.normal(size=(columns, size)), basis, 1e-9)
        if basis.shape[1] + block.shape[1] > most:
            keep = turn[:, : k + EXTRA]
            basis, images = basis @ keep, images @ keep
    else:
        warnings.warn(f"singular vectors did not converge: residual {worst:.1e} after {passes} passes", stacklevel=2)
    return basis @ turn[:, :k], np.sqrt(np.maximum(square[:k], 0.0)), worst


def singular_vectors(vectors: DataFrame, col: str, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """``leading`` for a vector column; places and values are written once for all passes and deleted in the end."""
    narrow = vectors.select(places(F.col(col)).alias("at"), values(F.col(col)).alias("value"), width(F.col(col)).alias("width"))
    with settled(narrow) as rows:
        columns = rows.agg(F.max("width")).first()[0]
        if not columns:
            raise ValueError("no vectors to fit")
        return leading(rows.select("at", "value"), columns, k)


def per_row(df: DataFrame, vector: Column, work: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> Column:
    """An array per row from places, values and row lengths of Arrow batches; null for a null vector."""
    ship_package(df.sparkSession)

    @F.arrow_udf("array<double>")
    def run(at: pa.Array, value: pa.Array) -> pa.Array:
        lengths = pc.fill_null(pc.list_value_length(value), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        numbers = [c.flatten().to_numpy(zero_copy_only=False) for c in (at, value)]
        out = np.ascontiguousarray(work(numbers[0].astype(np.int64), numbers[1], lengths), float)
        bounds = pa.array(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1])
        return pa.ListArray.from_arrays(bounds, pa.array(out.reshape(-1)), mask=value.is_null())

    return run(places(vector), values(vector))


def total_variance(df: DataFrame, vector: str) -> float:
    """The sum over all columns of their population variance, from the stored entries alone."""
    rows = df.select(places(F.col(vector)).alias("at"), values(F.col(vector)).alias("value"))
    n = rows.filter("value is not null").count()
    cells = rows.select(F.explode(F.arrays_zip("at", "value")).alias("e")).select("e.at", "e.value")
    one = cells.groupBy("at").agg(F.count("value").alias("c"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    zeros = F.col("m") * F.col("m") * F.col("c") * (F.lit(n) - F.col("c")) / F.lit(max(n, 1))
    return one.agg(F.sum((F.col("v") * F.col("c") + zeros) / F.lit(max(n, 1)))).first()[0] or 0.0
