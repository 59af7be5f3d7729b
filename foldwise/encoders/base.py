"""What every fitted encoder shares: parameters, a dictionary table, saving, and the dictionary join."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from foldwise.operators.aggregates import unpivot
from foldwise.operators.skew import HEAVY_ROWS, fair_share, lookup
from foldwise import session
from foldwise.session import fits_broadcast, row_width, settle


class Fitted:
    """A fitted encoder: JSON parameters and, for dictionary encoders, a table."""

    def __init__(self, params: dict, table: DataFrame | None = None, small: bool | None = None):
        self.params = params
        self.table = table
        self.small = small if small is not None or table is None else fits_broadcast(table)

    def feature_names(self) -> list[str]:
        return list(self.params["outs"])

    def transform(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def save(self, spark: SparkSession, path: str) -> None:
        state = json.dumps({**self.params, "_small": self.small})
        spark.createDataFrame([(state,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/params")
        if self.table is not None:
            self.table.write.mode("overwrite").parquet(f"{path}/table")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Fitted":
        params = json.loads(spark.read.text(f"{path}/params").first()[0])
        small = params.pop("_small")
        table = None if small is None else spark.read.parquet(f"{path}/table")
        fitted = cls.__new__(cls)
        Fitted.__init__(fitted, params, table, small)
        return fitted


# more broadcast joins than this in one plan cost more than one shuffle
WIDE_COLUMNS = 64
# up to this many columns with a large dictionary, one join each costs less than one join of the unpivoted rows
LARGE_COLUMNS = 3


def _counted(table: DataFrame, on: Sequence[str]) -> list | None:
    """Heavy keys by the counts the dictionary already holds; None if it holds none."""
    if "cnt" not in table.columns:
        return None
    total = table.agg(F.sum("cnt")).first()[0] or 0
    floor = fair_share(table, total, HEAVY_ROWS, None)
    return table.filter(F.col("cnt") > floor).select(*on).collect() if total > floor else []


def _large_columns(table: DataFrame, cols: Sequence[str]) -> list[str]:
    """Columns whose part of the table is not broadcast: the smallest parts are, while they keep inside the bounds together."""
    sized = table.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.sum(row_width(table)).alias("size")).collect()
    found = {r["feature"]: (r["n"], r["size"]) for r in sized}  # one row per column
    rows = size = 0
    large = []
    for c in sorted(cols, key=lambda c: found.get(c, (0, 0))):
        rows, size = rows + found.get(c, (0, 0))[0], size + found.get(c, (0, 0))[1]
        if rows > session.BROADCAST_ROWS or size > session.BROADCAST_BYTES:
            large.append(c)
    return large


def map_columns(
    df: DataFrame,
    table: DataFrame,
    cols: Sequence[str],
    values: Sequence[str],
    small: bool,
    extra: Sequence[str] = (),
    as_type: str = "string",
) -> DataFrame:
    """Adds ``<value>|<col>`` for every column from a table ``(extra, feature, value, values...)``.

    With a small table and not too many columns, it is broadcast once per column
    and the rows are not moved. If the parts of only a few columns are large, the
    rows are joined once with each of these parts; heavy keys are known from its
    counts. Otherwise the rows are numbered in a written
    table, the columns are unpivoted, joined once, and put back by that number:
    a fixed number of shuffles however many columns there are. All ways give
    each row its own values, whatever null or repeated ids the rows have.
    """
    large = []
    if not small and len(cols) <= WIDE_COLUMNS and "cnt" in table.columns:
        large = _large_columns(table, cols)
    if len(cols) <= WIDE_COLUMNS and (small or ("cnt" in table.columns and len(large) <= LARGE_COLUMNS)):
        for c in cols:
            own = table.filter(F.col("feature") == c).withColumnRenamed("value", "_lookup")
            part = own.select(*extra, "_lookup", *[F.col(v).alias(f"{v}|{c}") for v in values])
            keyed = df.withColumn("_lookup", F.col(c).cast(as_type))
            on = [*extra, "_lookup"]
            heavy = _counted(own, on) if c in large else []
            df = lookup(keyed, part, on, small=c not in large, heavy=heavy).drop("_lookup")
        return df
    # written, so that a row keeps its number if a task runs again
    numbered = settle(df.withColumn("_row", F.monotonically_increasing_id()))
    long = unpivot(numbered, cols, ["_row", *extra], as_type)
    on = [*extra, "feature", "value"]
    found = lookup(long, table.select(*on, *values), on, small=small, spread=["_row"], heavy=None if small else _counted(table, on))
    wide = found.groupBy("_row").agg(
        *[F.max(F.when(F.col("feature") == c, F.col(v))).alias(f"{v}|{c}") for c in cols for v in values]
    )
    return numbered.join(wide, "_row", "left").drop("_row")


def with_combinations(df: DataFrame, combinations: Sequence[Sequence[str]]) -> tuple[DataFrame, list[str]]:
    """Adds the concatenation of each column tuple under the joined names."""
    names = ["_".join(c) for c in combinations]
    return df.withColumns({n: F.concat(*c) for n, c in zip(names, combinations)}), names
