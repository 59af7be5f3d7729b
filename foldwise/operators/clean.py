"""Projections, filters and cleaning."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

# fixed values: the column differences of the claim table
CLAIM_DIFFERENCES = (
    (1, 6), (1, 9), (1, 10), (6, 9), (6, 10), (6, 11), (6, 12), (6, 13), (7, 11), (7, 12), (11, 12),
)


def select_prefix(df: DataFrame, prefix: str, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, *[c for c in df.columns if c.startswith(prefix) and c not in keep])


def prefix_columns(df: DataFrame, prefix: str, keep: Sequence[str] = ()) -> DataFrame:
    return df.withColumnsRenamed({c: prefix + c for c in df.columns if c not in keep})


def fill_constants(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Null to a constant per column; a ``Column`` value is used as it is."""
    return df.withColumns(
        {c: F.coalesce(F.col(c), v if isinstance(v, Column) else F.lit(v)) for c, v in values.items()}
    )


def fill_with_minimum(df: DataFrame, col: str, source: str) -> DataFrame:
    """Null to the smallest value of another column over the whole table."""
    return df.withColumn(col, F.coalesce(F.col(col), df.agg(F.min(source)).scalar()))


def split_by_label(df: DataFrame, label: str, sentinel=-1, drop: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(labelled rows, rows whose label is the sentinel without the label column)."""
    known = df.filter(F.col(label) != sentinel).drop(*drop)
    unknown = df.filter(F.col(label) == sentinel).drop(label, *drop)
    return known, unknown


def is_missing(df: DataFrame, col: str) -> Column:
    kind = dict(df.dtypes)[col]
    return F.col(col).isNull() | F.isnan(col) if kind in ("double", "float") else F.col(col).isNull()


class DropSparse:
    """Keeps the columns whose missing share is below ``max_null``; fitted once, then the same list for every batch."""

    def __init__(self, max_null: float = 0.9):
        self.max_null = max_null
        self.columns: list[str] | None = None

    def fit(self, df: DataFrame, cols: Sequence[str] | None = None) -> "DropSparse":
        cols = list(cols or df.columns)
        shares = df.agg(*[F.avg(is_missing(df, c).cast("int")).alias(c) for c in cols]).first()
        self.columns = [c for c in cols if shares[c] is not None and shares[c] < self.max_null]
        return self

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        return df.select(*keep, *[c for c in self.columns if c not in keep])


def row_null_count(df: DataFrame, cols: Sequence[str], out: str = "missing") -> DataFrame:
    return df.withColumn(out, sum((is_missing(df, c).cast("int") for c in cols), F.lit(0)))


def clip(df: DataFrame, cols: Sequence[str], lo: float | None = None, hi: float | None = None) -> DataFrame:
    def one(c):
        value = F.col(c)
        if lo is not None:
            value = F.greatest(value, F.lit(lo))
        if hi is not None:
            value = F.least(value, F.lit(hi))
        return F.when(F.col(c).isNotNull(), value)

    return df.withColumns({c: one(c) for c in cols})


def narrow_types(
    df: DataFrame, cols: Sequence[str] | None = None, tol: float = 0.01, fill: int = -999
) -> tuple[DataFrame, list[str]]:
    """Smallest type per numeric column, and the columns whose null or non-finite values became ``fill``."""
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "double")
    cols = list(cols or [c for c, t in df.dtypes if t in numeric])

    def bad(c):
        value = F.col(c).cast("double")
        return value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))

    def filled(c):
        return F.when(bad(c), F.lit(fill)).otherwise(F.col(c))

    facts = []
    for c in cols:
        value = filled(c).cast("double")
        facts += [
            F.min(value).alias(f"lo_{c}"),
            F.max(value).alias(f"hi_{c}"),
            F.sum(F.abs(value - value.cast("long"))).alias(f"frac_{c}"),
            F.max(bad(c)).alias(f"bad_{c}"),
        ]
    seen = df.agg(*facts).first()
    # fixed values: signed integer types and their bounds, narrowest first
    sizes = (("tinyint", 127), ("smallint", 32767), ("int", 2147483647), ("bigint", 9223372036854775807))
    casts, changed = {}, []
    for c in cols:
        if seen[f"bad_{c}"]:
            changed.append(c)
        lo, hi = seen[f"lo_{c}"], seen[f"hi_{c}"]
        if lo is None:
            continue
        if seen[f"frac_{c}"] < tol:
            kind = next(t for t, bound in sizes if -bound <= lo and hi <= bound or t == "bigint")
        else:
            kind = "float"
        casts[c] = filled(c).cast(kind)
    return df.withColumns(casts), changed


def with_sentinel_row(df: DataFrame, key: str, value=-1, fill=0) -> DataFrame:
    """Adds one row for the missing key, every other column ``fill``."""
    row = [F.lit(value if c == key else fill).cast(t).alias(c) for c, t in df.dtypes]
    return df.unionByName(df.sparkSession.range(1).select(*row))


def pair_differences(df: DataFrame, pairs: Sequence[tuple[str, str]], names: Sequence[str] | None = None) -> DataFrame:
    names = names or [f"diff_{a}_{b}" for a, b in pairs]
    return df.withColumns({n: F.col(a) - F.col(b) for n, (a, b) in zip(names, pairs)})


def claim_differences(df: DataFrame, prefix: str = "cont") -> DataFrame:
    pairs = [(f"{prefix}{a}", f"{prefix}{b}") for a, b in CLAIM_DIFFERENCES]
    return pair_differences(df, pairs, [f"diff_{a}_{b}" for a, b in CLAIM_DIFFERENCES])


class EdgeFlags:
    """Flags a column's exact 0 or 1 when more than ``min_count`` rows hold it."""

    NAMES = {0: "zero", 1: "one"}

    def __init__(self, cols: Sequence[str], values: Sequence[float] = (0, 1), min_count: int = 20):
        self.cols, self.values, self.min_count = list(cols), list(values), min_count
        self.chosen: list[tuple[str, float]] = []

    def _name(self, c, v):
        return f"{c}_{self.NAMES.get(v, v)}"

    def fit(self, df: DataFrame) -> "EdgeFlags":
        pairs = [(c, v) for c in self.cols for v in self.values]
        counts = df.agg(*[F.count_if(F.col(c) == float(v)).alias(self._name(c, v)) for c, v in pairs]).first()
        self.chosen = [(c, v) for c, v in pairs if counts[self._name(c, v)] > self.min_count]
        return self

    def feature_names(self) -> list[str]:
        return [self._name(c, v) for c, v in self.chosen]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {self._name(c, v): F.coalesce((F.col(c) == float(v)).cast("int"), F.lit(0)) for c, v in self.chosen}
        )


def equal_flags(df: DataFrame, pairs: Mapping[str, tuple[str, str]]) -> DataFrame:
    """0-1 flags of equality; null never equals null."""
    return df.withColumns(
        {n: F.coalesce((F.col(a) == F.col(b)).cast("int"), F.lit(0)) for n, (a, b) in pairs.items()}
    )


def group_classes(col: Column, groups: Mapping[str, Sequence], otherwise: str) -> Column:
    result = None
    for label, members in groups.items():
        hit = col.isin(list(members))
        result = F.when(hit, F.lit(label)) if result is None else result.when(hit, F.lit(label))
    return result.otherwise(F.lit(otherwise))


# fixed values: transport modes by means of travel
MODE_GROUPS = {"transit": (1, 2, 5, 7, 9, 10, 11), "car": (3,), "taxi": (4, 8)}
MODE_OTHER = "other"


def fill_by_class(df: DataFrame, col: str, class_col: str, classes: Sequence, value) -> DataFrame:
    return df.withColumn(col, F.when(F.col(class_col).isin(list(classes)), F.lit(value)).otherwise(F.col(col)))


def cap_where(df: DataFrame, col: str, condition: Column, hi) -> DataFrame:
    return df.withColumn(col, F.when(condition, F.least(F.col(col), F.lit(hi))).otherwise(F.col(col)))


def slice_rows(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key).distinct(), key, "left_semi")


def add_powers(df: DataFrame, cols: Sequence[str], powers: Sequence[float]) -> DataFrame:
    return df.withColumns({f"{c}^{p}": F.pow(F.col(f"`{c}`"), F.lit(float(p))) for p in powers for c in cols})


def split_by_time(df: DataFrame, ts: str, at: str) -> tuple[DataFrame, DataFrame]:
    edge = F.lit(at).cast("timestamp")
    return df.filter(F.col(ts) <= edge), df.filter(F.col(ts) > edge)
