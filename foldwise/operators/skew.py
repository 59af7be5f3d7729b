"""Work on keys of which one may hold a large share of all rows.

``heavy_keys`` finds them, ``OrderedGroups`` cuts their ordered history into
segments, ``lookup`` joins a dictionary without sending them to one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from foldwise.session import fits_broadcast, settle, task_count

# A group below this many rows is ordinary work for one task.
HEAVY_ROWS = 1_000_000
# rows of a group that share one copy of its past
BLOCK_ROWS = 2048


def heavy_keys(df: DataFrame, keys: Sequence[str], min_rows: int = HEAVY_ROWS, pieces: int | None = None) -> list:
    """Key rows (with ``_n``) that hold more than ``1/pieces`` of the rows and more than ``min_rows``.

    Fewer than ``pieces`` keys can do so; that bounds the list the driver receives.
    """
    total = df.count()
    if total <= min_rows:
        return []
    floor = fair_share(df, total, min_rows, pieces)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return counts.filter(F.col("_n") > floor).collect()


def fair_share(df: DataFrame, total: int, min_rows: int, pieces: int | None) -> int:
    """Rows one task should get."""
    return max(min_rows, total // (pieces or task_count(df.sparkSession)))


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join where null equals null; the keys of the left side stay."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    condition = None
    for k in keys:
        part = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        condition = part if condition is None else condition & part
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


class OrderedGroups:
    """Rows ordered inside groups, with running sums and lags that also work for a heavy group.

    A group above the fair share of one task is cut into contiguous segments. A
    segment is a window partition of its own; what the earlier segments hand
    over is a table with one row per segment. There are fewer heavy keys than
    ``pieces`` and fewer segments than twice that, so this table can be
    broadcast whatever the data size. The cut points come from a bounded sample
    and only steer the balance; every result is exact.

    ``base`` is the input with its segment, before any window: the tables handed
    over are computed from it, so the work does not grow with the operators
    chained.
    """

    SAMPLE_PER_SEGMENT = 32

    def __init__(
        self,
        df: DataFrame,
        keys: Sequence[str],
        order: Sequence[str],
        min_rows: int = HEAVY_ROWS,
        pieces: int | None = None,
    ):
        self.keys, self.order = list(keys), list(order)
        heavy = heavy_keys(df, self.keys, min_rows, pieces)
        self.split = bool(heavy)
        if self.split:
            self.base = self._cut(df, heavy, fair_share(df, df.count(), min_rows, pieces))
        else:
            self.base = df.withColumn("_seg", F.lit(0))
        self.df = self.base

    def _cut(self, df: DataFrame, heavy: list, share: int) -> DataFrame:
        spark = df.sparkSession
        key_fields = [T.StructField(k, df.schema[k].dataType) for k in self.keys]
        keys = [tuple(r[k] for k in self.keys) for r in heavy]
        wanted = spark.createDataFrame(keys, T.StructType(key_fields))
        hot = join_null_safe(df.select(*self.keys, *self.order), F.broadcast(wanted), self.keys, "left_semi")
        points = hot.sample(fraction=min(1.0, self.SAMPLE_PER_SEGMENT / share), seed=7).collect()
        by_key: dict = {k: [] for k in keys}
        for p in points:
            by_key[tuple(p[k] for k in self.keys)].append(tuple(p[c] for c in self.order))
        rows = []
        for r, key in zip(heavy, keys):
            found = sorted(by_key[key], key=lambda t: tuple((v is not None, v) for v in t))
            n = math.ceil(r["_n"] / share)
            cuts = [found[i * len(found) // n] for i in range(1, n)] if found else []
            # two levels, so a row is compared with about twice the root of the number of cuts
            size = max(1, math.isqrt(len(cuts)))
            rows.append((*key, cuts[::size], [cuts[i : i + size] for i in range(0, len(cuts), size)], size))
        point = T.ArrayType(T.StructType([T.StructField(c, df.schema[c].dataType) for c in self.order]))
        fields = [T.StructField("_coarse", point), T.StructField("_fine", T.ArrayType(point)), T.StructField("_size", T.IntegerType())]
        table = spark.createDataFrame(rows, T.StructType([*key_fields, *fields]))
        here = F.struct(*self.order)
        block = F.size(F.filter("_coarse", lambda p: p <= here))
        inside = F.size(F.filter(F.get("_fine", F.col("_block") - 1), lambda p: p <= here))
        return (
            join_null_safe(df, F.broadcast(table), self.keys)
            .withColumn("_heavy", F.col("_coarse").isNotNull())
            .withColumn("_block", F.when(F.col("_heavy"), block).otherwise(F.lit(0)))
            .withColumn("_seg", F.when(F.col("_block") > 0, (F.col("_block") - 1) * F.col("_size") + inside).otherwise(F.lit(0)))
            .drop("_coarse", "_fine", "_size", "_block")
        )

    @property
    def window(self):
        return Window.partitionBy(*self.keys, "_seg").orderBy(*self.order)

    def _with_carry(self, summary: dict[str, Column], carry: dict[str, Column]) -> DataFrame:
        parts = self.base.filter("_heavy").groupBy(*self.keys, "_seg").agg(*[e.alias(n) for n, e in summary.items()])
        before = Window.partitionBy(*self.keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
        table = parts.select(*self.keys, "_seg", *[e.over(before).alias(n) for n, e in carry.items()])
        return join_null_safe(self.df, F.broadcast(table), [*self.keys, "_seg"])

    def running_sum(self, sums: dict[str, Column], inclusive: bool = False) -> "OrderedGroups":
        """Adds, per output name, the sum of an expression of input columns over the earlier (or earlier and current) rows."""
        terms = {n: F.coalesce(e.cast("long"), F.lit(0)) for n, e in sums.items()}
        frame = self.window.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        if self.split:
            self.df = self._with_carry(
                {f"_c_{n}": F.sum(e) for n, e in terms.items()},
                {f"_c_{n}": F.sum(f"_c_{n}") for n in sums},
            )
        out = {}
        for n, e in terms.items():
            local = F.coalesce(F.sum(e).over(frame), F.lit(0))
            out[n] = local + F.coalesce(F.col(f"_c_{n}"), F.lit(0)) if self.split else local
        self.df = self.df.withColumns(out).drop(*[f"_c_{n}" for n in sums])
        return self

    def before_first(self, out: str, condition: Column) -> "OrderedGroups":
        """Adds a flag: no row of the group up to and including this one meets the condition.

        The flag of a heavy group compares with its first such row (one row per
        heavy key), so it is an input column for later operators.
        """
        frame = self.window.rowsBetween(Window.unboundedPreceding, 0)
        met = F.coalesce(condition, F.lit(False))
        local = F.max(met.cast("int")).over(frame) == 0
        if not self.split:
            self.df = self.df.withColumn(out, local)
            return self
        here = F.struct(*self.order)
        first = self.base.filter("_heavy").filter(met).groupBy(*self.keys).agg(F.min(here).alias("_first"))
        open_ = F.col("_first").isNull() | (here < F.col("_first"))
        flagged = join_null_safe(self.base, F.broadcast(first), self.keys)
        self.base = flagged.withColumn(out, open_).drop("_first")
        self.df = (
            join_null_safe(self.df, F.broadcast(first), self.keys)
            .withColumn(out, F.when(F.col("_heavy"), open_).otherwise(local))
            .drop("_first")
        )
        return self

    def lag(self, columns: dict[str, str]) -> "OrderedGroups":
        """Adds, per output name, the value of an input column in the previous row (null for the first)."""
        if self.split:
            here = F.struct(*self.order)
            self.df = self._with_carry(
                {f"_c_{n}": F.max_by(F.struct(F.col(c).alias("v")), here) for n, c in columns.items()},
                {f"_c_{n}": F.last(f"_c_{n}") for n in columns},
            )
            first = F.row_number().over(self.window) == 1
            out = {
                n: F.when(first, F.col(f"_c_{n}")["v"]).otherwise(F.lag(c).over(self.window))
                for n, c in columns.items()
            }
        else:
            out = {n: F.lag(c).over(self.window) for n, c in columns.items()}
        self.df = self.df.withColumns(out).drop(*[f"_c_{n}" for n in columns])
        return self

    def last_values(self, out: str, col: str, max_len: int) -> "OrderedGroups":
        """Adds the list of the values in the last ``max_len`` earlier rows, oldest first."""
        boxed = F.struct(F.col(col).alias("v"))  # collect_list would drop a bare null
        local = F.collect_list(boxed).over(self.window.rowsBetween(-max_len, -1))
        if self.split:
            backwards = Window.partitionBy(*self.keys, "_seg").orderBy(*[F.desc(c) for c in self.order])
            placed = self.base.filter("_heavy").withColumn("_place", F.row_number().over(backwards))
            tail = (
                placed.filter(F.col("_place") <= max_len)
                .groupBy(*self.keys, "_seg")
                .agg(F.array_sort(F.collect_list(F.struct((-F.col("_place")).alias("p"), boxed.alias("b")))).alias("_tail"))
            )
            before = Window.partitionBy(*self.keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
            lists = F.flatten(F.collect_list("_tail").over(before))
            table = tail.select(*self.keys, "_seg", F.transform(lists, lambda t: t["b"]).alias("_tails"))
            self.df = join_null_safe(self.df, F.broadcast(table), [*self.keys, "_seg"])
            local = F.when(F.col("_tails").isNull(), local).otherwise(F.concat("_tails", local))
            local = F.slice(local, F.greatest(F.size(local) - max_len + 1, F.lit(1)), max_len)
        self.df = self.df.withColumn(out, F.transform(local, lambda b: b["v"])).drop("_tails")
        return self

    def whole_past(self, out: str, col: str, sep: str | None = None) -> "OrderedGroups":
        """Adds the list of the values in all earlier rows, oldest first; or with ``sep`` their text, joined, without nulls.

        A row's past is the front of what its group holds, so no list is built row by row: the rows of a group are
        dealt in blocks, a block gets the values up to its own last row once, and each of its rows copies the front
        that it needs, one row at a time. What is sent grows with the rows of a group times its blocks;
        the result itself is quadratic in a group.
        """
        piece = F.col(col) if sep is None else F.concat(F.col(col).cast("string"), F.lit(sep))
        size = F.lit(1) if sep is None else F.octet_length(piece)
        self.running_sum({"_place": F.lit(1)} if sep is None else {"_place": F.lit(1), "_size": size})
        at = F.struct(*self.keys, F.floor(F.col("_place") / BLOCK_ROWS).alias("block"))
        rows = settle(self.df.withColumn("_at", at))
        named = F.struct("_place", piece.alias("v"))
        own = F.transform(F.array_sort(F.collect_list(named)), lambda x: x["v"])
        blocks = rows.groupBy("_at").agg((own if sep is None else F.array_join(own, "")).alias("_own"))
        until = Window.partitionBy(*[F.col("_at")[k] for k in self.keys]).orderBy(F.col("_at")["block"])
        parts = F.collect_list("_own").over(until.rowsBetween(Window.unboundedPreceding, 0))
        front = F.flatten(parts) if sep is None else F.array_join(parts, "").cast("binary")
        blocks = settle(blocks)
        tasks = max(1, min(blocks.count(), 4 * task_count(rows.sparkSession)))
        fronts = blocks.select("_at", front.alias("_front")).repartition(tasks, "_at")
        # merged, so that a task holds one front and streams the rows of its block, in their order: each begins with the one before
        met = rows.repartition(tasks, "_at").sortWithinPartitions("_at", "_place").join(fronts.hint("merge"), "_at")
        if sep is None:
            past = F.slice("_front", F.lit(1), F.col("_place").cast("int"))
        else:  # cut as bytes, which copies; in text the place of a character would be counted from the start
            length = F.greatest(F.col("_size") - len(sep.encode()), F.lit(0)).cast("int")
            past = F.substring("_front", F.lit(1), length).cast("string")
        self.df = met.withColumn(out, past).drop("_at", "_front", "_place", "_size")
        return self

    def result(self) -> DataFrame:
        return self.df.drop("_seg", "_heavy")


def lookup(
    df: DataFrame,
    dictionary: DataFrame,
    on: Sequence[str],
    small: bool | None = None,
    spread: Sequence[str] | None = None,
    heavy: list | None = None,
) -> DataFrame:
    """Left join with a dictionary that is unique on ``on`` (null matches null).

    A dictionary inside the broadcast bounds (measured) is broadcast. A larger
    one is shuffled; then rows of heavy keys take their values from the few
    broadcast heavy dictionary rows, and enter the shuffle under a scattered
    key, so no task receives more than its share.
    """
    on = list(on)
    if small is None:
        # read twice, once to measure it: computed once
        dictionary = settle(dictionary)
        small = fits_broadcast(dictionary)
    if small:
        return join_null_safe(df, F.broadcast(dictionary), on)
    values = [c for c in dictionary.columns if c not in on]
    heavy = heavy_keys(df, on) if heavy is None else heavy
    if not heavy:
        return join_null_safe(df, dictionary, on)
    spark = df.sparkSession
    schema = T.StructType([T.StructField(k, df.schema[k].dataType) for k in on])
    keys = spark.createDataFrame([tuple(r[k] for k in on) for r in heavy], schema)
    few = join_null_safe(
        keys.withColumn("_heavy", F.lit(True)), dictionary, on
    ).withColumnsRenamed({v: f"_h_{v}" for v in values})
    spread_by = F.xxhash64(*(spread or df.columns)) % F.lit(64 * task_count(spark))
    tagged = join_null_safe(df, F.broadcast(few), on).withColumn(
        "_salt", F.when(F.col("_heavy"), spread_by).otherwise(F.lit(-1))
    )
    # the dictionary only carries salt -1: a heavy row finds nothing there and is spread evenly
    joined = join_null_safe(tagged, dictionary.withColumn("_salt", F.lit(-1).cast("long")), [*on, "_salt"])
    picked = {v: F.when(F.col("_heavy"), F.col(f"_h_{v}")).otherwise(F.col(v)) for v in values}
    return joined.withColumns(picked).drop("_salt", "_heavy", *[f"_h_{v}" for v in values])
