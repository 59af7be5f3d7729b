"""Encoders of categories: codes, counts, flags, target means, token ranks."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from foldwise.encoders.base import Fitted, map_columns, with_combinations
from foldwise.functions.hashing import hash_normal
from foldwise.functions.numeric import alpha_code, tokens
from foldwise.operators.aggregates import frequencies, target_stats, unpivot
from foldwise.operators.skew import HEAVY_ROWS, OrderedGroups
from foldwise.session import fits_broadcast, settle


class CodeModel(Fitted):
    """Replaces each column by one number of the dictionary."""

    def transform(self, df: DataFrame) -> DataFrame:
        p = self.params
        df = map_columns(df, self.table, p["cols"], [p["pick"]], self.small)
        outs = {}
        for c, o in zip(p["cols"], p["outs"]):
            value = F.col(f"{p['pick']}|{c}")
            outs[o] = value if p["unseen"] is None else F.coalesce(value, F.lit(p["unseen"]))
        return df.withColumns(outs).drop(*[f"{p['pick']}|{c}" for c in p["cols"]])


class OrdinalEncode:
    """Codes 0..n-1 per column in length-then-lexical (``len_lex``) or ``lexical`` order."""

    def __init__(self, cols: Sequence[str], order: str = "len_lex", suffix: str = "_code", key: str | None = None, min_rows: int = HEAVY_ROWS):
        self.cols, self.order, self.suffix, self.key, self.min_rows = list(cols), order, suffix, key, min_rows

    def fit(self, df: DataFrame) -> CodeModel:
        pairs = unpivot(df, self.cols).filter("value is not null").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("cnt"))
        levels = settle(pairs.withColumn("_len", F.length("value")))
        order = ["_len", "value"] if self.order == "len_lex" else ["value"]
        ranked = OrderedGroups(levels, ["feature"], order, self.min_rows).running_sum({"code": F.lit(1)}).result()
        table = ranked.select("feature", "value", F.col("code").cast("int").alias("code"), "cnt")
        params = {
            "cols": self.cols,
            "outs": [c + self.suffix for c in self.cols],
            "pick": "code",
            "unseen": None,
            "key": self.key,
        }
        return CodeModel(params, table, fits_broadcast(levels))


def label_encode(cols: Sequence[str], **kw) -> OrdinalEncode:
    """Lexical codes, independent per column."""
    return OrdinalEncode(cols, order="lexical", **kw)


class FrequencyEncode:
    """Rows per value; with ``null`` given, null is a level of its own under that name."""

    def __init__(self, cols: Sequence[str], null: str | None = None, unseen: int | None = None, suffix: str = "_count", key: str | None = None):
        self.cols, self.null, self.unseen, self.suffix, self.key = list(cols), null, unseen, suffix, key

    def fit(self, df: DataFrame) -> CodeModel:
        counts = frequencies(df, self.cols)
        if self.null is None:
            counts = counts.filter("value is not null")
        else:
            # the named level and a real value of that name are one level, as after filling
            merged = counts.withColumn("value", F.coalesce("value", F.lit(self.null)))
            named = merged.groupBy("feature", "value").agg(F.sum("cnt").alias("cnt"))
            as_null = named.filter(F.col("value") == self.null).withColumn("value", F.lit(None).cast("string"))
            counts = named.unionByName(as_null)
        params = {
            "cols": self.cols,
            "outs": [c + self.suffix for c in self.cols],
            "pick": "cnt",
            "unseen": self.unseen,
            "key": self.key,
        }
        return CodeModel(params, settle(counts))


class OneHotModel(Fitted):
    """Table (feature, value, flag, place): which flag a value sets."""

    # names on the driver are for vectors of a width a learner can take
    MAX_NAMES = 1 << 20

    def feature_names(self) -> list[str]:
        p = self.params
        if sum(p["widths"].values()) > self.MAX_NAMES:
            raise ValueError("too many flags for one list of names; use the long form")
        order = {c: i for i, c in enumerate(p["cols"])}
        flags = self.table.select("feature", "place", "flag").distinct().collect()
        return [r["flag"] for r in sorted(flags, key=lambda r: (order[r["feature"]], r["place"]))]

    def transform(self, df: DataFrame) -> DataFrame:
        """Long form (key, flag, value = 1); nothing for null, unseen and unwanted rare values."""
        p = self.params
        long = unpivot(df, p["cols"], [p["key"]])
        table = self.table.select("feature", "value", "flag")
        hit = long.join(F.broadcast(table) if self.small else table, ["feature", "value"])
        return hit.select(p["key"], "flag", F.lit(1).alias("value"))

    def assemble(self, df: DataFrame, out: str = "flags") -> DataFrame:
        """Adds one sparse vector of all flags in ``feature_names`` order."""
        p = self.params
        df = map_columns(df, self.table, p["cols"], ["place"], self.small)
        slots = []
        for c in p["cols"]:
            width = p["widths"][c]
            if width == 0:
                continue
            # the extra last slot means no flag and is dropped by the encoder
            place = F.coalesce(F.col(f"place|{c}"), F.lit(width)).cast("double")
            meta = {"ml_attr": {"type": "nominal", "name": c, "num_vals": width + 1}}
            df = df.withColumn(f"_slot_{c}", place.alias(f"_slot_{c}", metadata=meta))
            slots.append(f"_slot_{c}")
        hot = [f"_hot{s}" for s in slots]
        df = OneHotEncoder(inputCols=slots, outputCols=hot, dropLast=True, handleInvalid="error").fit(df).transform(df)
        df = VectorAssembler(inputCols=hot, outputCol=out).transform(df)
        return df.drop(*slots, *hot, *[f"place|{c}" for c in p["cols"]])


class OneHotRare:
    """Flags for values with at least ``min_freq`` training rows, and one flag for the rarer ones.

    The rare flag exists only if rare values occur in both training and test
    rows. Values seen only in test rows set no flag.
    """

    def __init__(self, cols: Sequence[str], min_freq: int = 10, key: str = "id"):
        self.cols, self.min_freq, self.key = list(cols), min_freq, key

    def fit(self, train: DataFrame, test: DataFrame) -> OneHotModel:
        tagged = train.select(*self.cols, F.lit(1).alias("_train")).unionByName(test.select(*self.cols, F.lit(0).alias("_train")))
        counts = (
            unpivot(tagged, self.cols, ["_train"])
            .filter("value is not null")
            .groupBy("feature", "value")
            .agg(F.sum("_train").alias("n_train"), F.sum(1 - F.col("_train")).alias("n_test"))
            .filter("n_train > 0")
        )
        counts = settle(counts)
        rare = F.col("n_train") < self.min_freq
        use_rare = counts.filter(rare).groupBy("feature").agg((F.sum("n_test") > 0).alias("_rare"))  # one row per column
        flags = counts.join(F.broadcast(use_rare), "feature", "left")
        flags = flags.filter(~rare | F.coalesce("_rare", F.lit(False))).select(
            "feature", "value", F.when(rare, F.lit(None)).otherwise(F.col("value")).alias("level")
        )
        # nulls last: the rare flag takes the place behind the kept values
        levels = flags.select("feature", "level").distinct().withColumn("_last", F.col("level").isNull())
        placed = OrderedGroups(levels, ["feature"], ["_last", "level"]).running_sum({"place": F.lit(1)}).result()
        placed = settle(placed.withColumn("flag", F.concat_ws("_", "feature", F.coalesce("level", F.lit("rare")))))
        same = [flags["feature"] == placed["feature"], flags["level"].eqNullSafe(placed["level"])]
        table = flags.join(placed, same).select(flags["feature"], "value", "flag", F.col("place").cast("int").alias("place"))
        found = dict(placed.groupBy("feature").agg(F.count(F.lit(1))).collect())  # one row per column
        widths = {c: found.get(c, 0) for c in self.cols}
        params = {"cols": self.cols, "widths": widths, "key": self.key}
        return OneHotModel(params, table, fits_broadcast(counts))


class TargetMeanModel(Fitted):
    def _value(self, c: str, prior, own_target: Column | None) -> Column:
        top = F.coalesce(F.col(f"target_sum|{c}"), F.lit(0.0)) + prior
        bottom = F.coalesce(F.col(f"cnt|{c}"), F.lit(0)) + F.lit(float(self.params["C"]))
        if own_target is not None:
            top, bottom = top - own_target, bottom - 1
        return F.exp(top / bottom)

    def _mapped(self, df: DataFrame) -> DataFrame:
        p = self.params
        df, _ = with_combinations(df, p["combinations"])
        return map_columns(df, self.table, p["cols"], ["target_sum", "cnt"], self.small, p["extra"])

    def _finish(self, df: DataFrame, prior, own_target) -> DataFrame:
        p = self.params
        outs = {o: self._value(c, prior(c), own_target) for c, o in zip(p["cols"], p["outs"])}
        done = df.withColumns(outs).drop(*[f"{v}|{c}" for c in p["cols"] for v in ("target_sum", "cnt")])
        return done.drop(*["_".join(c) for c in p["combinations"]])

    def transform(self, df: DataFrame) -> DataFrame:
        """Smoothed means for rows that were not fitted; an unseen value gets the prior."""
        p = self.params
        return self._finish(self._mapped(df), lambda c: F.lit(p["mean"] * p["C"]), None)

    def transform_fitted(self, df: DataFrame) -> DataFrame:
        """Smoothed means for the fitted rows, with the noise and leave-one-out options."""
        p = self.params

        def prior(c):
            centre = F.lit(p["mean"] * p["C"])
            if not p["noisy"]:
                return centre
            spread = p["std"] * math.sqrt(p["C"])
            return centre + F.lit(spread) * hash_normal(F.col(p["key"]), f"{p['seed']}{c}")

        own = log_target(p["target"], p["offset"]) if p["loo"] else None
        return self._finish(self._mapped(df), prior, own)


def log_target(target: str, offset: float) -> Column:
    return F.log(F.col(target) + F.lit(float(offset)))


class TargetMean:
    """Mean of ``log(target + 100)`` per category, shrunk towards the overall mean by ``C`` rows."""

    def __init__(
        self,
        cols: Sequence[str],
        target: str,
        C: float = 100,
        loo: bool = False,
        noisy: bool = True,
        noise_std: float | None = None,
        seed: int = 11,
        combinations: Sequence[Sequence[str]] = (),
        key: str = "id",
        offset: float = 100,
        suffix: str = "_mean",
    ):
        self.cols, self.target, self.C, self.loo, self.noisy = list(cols), target, C, loo, noisy
        self.noise_std, self.seed, self.combinations = noise_std, seed, [list(c) for c in combinations]
        self.key, self.offset, self.suffix = key, offset, suffix

    def _params(self, cols: list[str], facts, extra: list[str]) -> dict:
        std = facts["std"] if self.noise_std is None else self.noise_std
        return {
            "cols": cols,
            "outs": [c + self.suffix for c in cols],
            "combinations": self.combinations,
            "C": self.C,
            "loo": self.loo,
            "noisy": self.noisy,
            "seed": self.seed,
            "key": self.key,
            "target": self.target,
            "offset": self.offset,
            "mean": facts["mean"],
            "std": std,
            "extra": extra,
        }

    def prepared(self, df: DataFrame) -> tuple[DataFrame, list[str]]:
        df, names = with_combinations(df, self.combinations)
        return df.withColumn("_t", log_target(self.target, self.offset)), [*self.cols, *names]

    def fit(self, df: DataFrame) -> TargetMeanModel:
        rows, cols = self.prepared(df)
        facts = rows.agg(F.avg("_t").alias("mean"), F.stddev_samp("_t").alias("std")).first()
        table = settle(target_stats(rows, cols, "_t").filter("value is not null"))
        return TargetMeanModel(self._params(cols, facts, []), table)


class AlphaEncode:
    """Letters of columns and of column tuples as base-26 numbers; nothing to fit."""

    def __init__(self, cols: Sequence[str], combinations: Sequence[Sequence[str]] = (), suffix: str = "_alpha"):
        self.cols, self.combinations, self.suffix = list(cols), list(combinations), suffix

    def fit(self, df: DataFrame) -> "AlphaEncode":
        return self

    def feature_names(self) -> list[str]:
        return [c + self.suffix for c in self.cols] + ["_".join(c) + self.suffix for c in self.combinations]

    def transform(self, df: DataFrame) -> DataFrame:
        sources = [F.col(c) for c in self.cols] + [F.concat(*c) for c in self.combinations]
        return df.withColumns({n: alpha_code(s) for n, s in zip(self.feature_names(), sources)})


class MultiValueModel(Fitted):
    def transform(self, df: DataFrame) -> DataFrame:
        p = self.params
        ranked = F.array(*[F.lit(t) for t in p["top"]])
        # most tokens are frequent ones, so the search ends early
        place = lambda t: F.array_position(ranked, t)
        ranks = F.transform(
            tokens(F.col(p["col"]), p["sep"], p["missing"]),
            lambda t: F.when(place(t) > 0, place(t) - 1).otherwise(F.lit(p["cap"])),
        )
        return df.withColumn(p["outs"][0], F.array_min(ranks).cast("int"))


class MultiValueEncode:
    """Rank of the most common token in each list; ranks from ``max_cat_num`` on are one level.

    Only the ``max_cat_num`` most frequent tokens have a rank of their own, so
    the fitted state is bounded by that parameter and rows are never moved.
    """

    def __init__(self, col: str, max_cat_num: int = 1000, sep: str = ",", missing: str = "-1", suffix: str = "_mv"):
        self.col, self.max_cat_num, self.sep, self.missing, self.suffix = col, max_cat_num, sep, missing, suffix

    def fit(self, df: DataFrame) -> MultiValueModel:
        each = df.select(F.explode(tokens(F.col(self.col), self.sep, self.missing)).alias("token"))
        counts = each.groupBy("token").agg(F.count(F.lit(1)).alias("cnt"))
        top = counts.orderBy(F.desc("cnt"), "token").limit(self.max_cat_num).collect()
        params = {
            "col": self.col,
            "outs": [self.col + self.suffix],
            "top": [r["token"] for r in top],
            "cap": self.max_cat_num,
            "sep": self.sep,
            "missing": self.missing,
        }
        return MultiValueModel(params)
