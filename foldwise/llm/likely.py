"""A first filter by a bitmap, for joins of a large table with the few keys that are wanted of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# bits of the table that bitmap_construct_agg makes
SLICE = 1 << 15
# bits for each key, and of all keys together: 8 MB, beyond which more rows pass by chance
BITS_PER_KEY = 16
MOST_BITS = 1 << 26


def likely_among(df: DataFrame, few: DataFrame, on: Sequence[str], most_bits: int = MOST_BITS) -> DataFrame:
    """The rows of ``df`` whose columns ``on`` occur in ``few``, a written table, and a small share of the others.

    A join that follows finds the same rows as without this filter, but sends little of the rest.
    That join should be an inner one: the optimizer moves a semi join below this filter.
    """
    wanted = (BITS_PER_KEY * few.count()).bit_length()
    n_bits = min(most_bits, max(SLICE, 1 << wanted))

    def slot(columns: Sequence[str]) -> Column:
        return F.pmod(F.xxhash64(*columns), F.lit(n_bits))

    slots = few.select(slot(on).alias("_slot")).withColumn("_slice", F.expr(f"_slot div {SLICE}"))
    bitmaps = (
        slots.repartition("_slice").groupBy("_slice").agg(F.bitmap_construct_agg(F.col("_slot") % SLICE).alias("_bitmap"))
    )
    byte = f"cast(conv(hex(substring(_bitmap, cast(_slot % {SLICE} div 8 + 1 as int), 1)), 16, 10) as int)"
    return (
        df.withColumn("_slot", slot(on))
        .withColumn("_slice", F.expr(f"_slot div {SLICE}"))
        .join(F.broadcast(bitmaps), "_slice")
        .filter(f"bit_get({byte}, cast(_slot % 8 as int)) = 1")
        .select(*df.columns)
    )
