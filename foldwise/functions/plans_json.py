"""JSON lists of travel plans: parse, explode, and row-wise list features (no shuffle)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

# fixed values: the fields of one plan; numbers arrive as text because price may be ''
PLAN_SCHEMA = T.ArrayType(
    T.StructType(
        [
            T.StructField("distance", T.StringType()),
            T.StructField("price", T.StringType()),
            T.StructField("eta", T.StringType()),
            T.StructField("transport_mode", T.StringType()),
        ]
    )
)


def parse_plans(text: Column) -> Column:
    """JSON text to a list of plans; null and malformed text give the empty list."""
    parsed = F.from_json(text, PLAN_SCHEMA)
    # text that is not a list parses to one plan without fields
    is_list = F.trim(text).startswith("[")
    return F.coalesce(F.when(is_list, parsed), F.array().cast(PLAN_SCHEMA))


def empty_to(col: Column, value=None) -> Column:
    """Empty text becomes ``value`` (null by default)."""
    return F.when(col == "", F.lit(value)).otherwise(col)


def numeric_plans(plans: Column, empty_price=0) -> Column:
    """Parsed plans with the numbers as long; an empty price becomes ``empty_price``, text that is no number null."""

    def whole(text):
        # fractions are cut off
        return text.try_cast("double").cast("long")

    return F.transform(
        plans,
        lambda p: F.struct(
            whole(p["distance"]).alias("distance"),
            F.when(p["price"] == "", F.lit(empty_price).cast("long")).otherwise(whole(p["price"])).alias("price"),
            whole(p["eta"]).alias("eta"),
            whole(p["transport_mode"]).cast("int").alias("mode"),
        ),
    )


def explode_plans(df: DataFrame, plans: str, keep: Sequence[str], outer: bool = False, empty_price=None) -> DataFrame:
    """One row per plan with ``pos`` (1-based) and distance, price, eta, mode."""
    items = df.select(*keep, numeric_plans(parse_plans(F.col(plans)), empty_price).alias("_plans"))
    # the inner form would make the optimizer test the list first, which parses the text once more per test
    rows = items.select(*keep, F.posexplode_outer("_plans").alias("_pos", "_plan"))
    if not outer:
        rows = rows.filter(F.col("_pos").isNotNull())
    return rows.select(*keep, (F.col("_pos") + 1).alias("pos"), "_plan.distance", "_plan.price", "_plan.eta", "_plan.mode")


def list_text(modes: Column, prefix: str = "word_", empty: str = "word_null") -> Column:
    """``word_7 word_2``; the empty list gives ``word_null``."""
    words = F.concat(F.lit(prefix), F.array_join(modes.cast("array<string>"), f" {prefix}"))
    return F.when(F.size(modes) == 0, F.lit(empty)).otherwise(words)


def list_sum(values: Column, squared: bool = False) -> Column:
    def add(acc, x):
        x = x.cast("double")
        return acc + (x * x if squared else x)

    return F.aggregate(values, F.lit(0.0), add)


def std_of(total: Column, squares: Column, n: Column) -> Column:
    """Population standard deviation from a sum, a sum of squares and a count."""
    mean = total / n
    return F.sqrt(F.greatest(squares / n - mean * mean, F.lit(0.0)))


def element_at_value(values: Column, value: Column, out: Column, last: bool = False) -> Column:
    """Element of ``out`` at the first (or last) place where ``values`` holds ``value``."""
    if last:
        return F.element_at(F.reverse(out), F.array_position(F.reverse(values), value).cast("int"))
    return F.element_at(out, F.array_position(values, value).cast("int"))
