"""Encoders of numbers: scaling, un-skewing, Box-Cox, Gaussian ranks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from foldwise.encoders.base import Fitted, map_columns
from foldwise.functions.numeric import erfinv
from foldwise.operators.aggregates import column_facts
from foldwise.operators.ordering import average_rank_of, ordered_counts_many
from foldwise.session import settle

FACTS = {"mean": F.avg, "std": F.stddev_pop, "min": F.min, "max": F.max}


class ScaleModel(Fitted):
    def transform(self, df: DataFrame) -> DataFrame:
        p = self.params
        outs = {}
        for c, o in zip(p["cols"], p["outs"]):
            f = p["facts"][c]
            centre = f["mean"] if p["with_mean"] else 0.0
            outs[o] = (F.col(c) - F.lit(centre)) / F.lit(f["std"] or 1.0)
        return df.withColumns(outs)


class Scale:
    """(x - mean) / population std; a constant column is divided by 1."""

    def __init__(self, cols: Sequence[str], with_mean: bool = True, suffix: str = "_scaled"):
        self.cols, self.with_mean, self.suffix = list(cols), with_mean, suffix

    def fit(self, df: DataFrame) -> ScaleModel:
        facts = column_facts(df, self.cols, {"mean": F.avg, "std": F.stddev_pop})
        outs = [c + self.suffix for c in self.cols]
        return ScaleModel({"cols": self.cols, "outs": outs, "with_mean": self.with_mean, "facts": facts})


# fixed values: hand-chosen reshaping of the claim columns
CLAIM_UNSKEW = {
    "cont1": "sqrt",
    "cont4": "sqrt",
    "cont5": "sqrt",
    "cont6": "log",
    "cont7": "log",
    "cont8": "sqrt",
    "cont9": "log",
    "cont10": "sqrt",
    "cont11": "sqrt",
    "cont12": "sqrt",
    "cont13": "log",
    "cont14": ("root4", 0.179722, 0.665122),
}
LOG_SHIFT = 0.1


class UnskewModel(Fitted):
    def transform(self, df: DataFrame) -> DataFrame:
        p = self.params
        outs = {}
        for (c, form), o in zip(p["spec"].items(), p["outs"]):
            f = p["facts"][c]
            span = (f["max"] - f["min"]) or 1.0
            unit = (F.col(c) - F.lit(f["min"])) / F.lit(span)
            if form == "sqrt":
                outs[o] = F.sqrt(unit)
            elif form == "log":
                outs[o] = F.log(unit + LOG_SHIFT)
            else:
                _, shift, scale = form
                kept = F.when(F.col(c).isNotNull(), F.greatest(F.col(c) - F.lit(shift), F.lit(0.0)))
                outs[o] = F.pow(kept / F.lit(scale), F.lit(0.25))
        return df.withColumns(outs)


class Unskew:
    """Square root or log of the min-max scaled value, or a shifted fourth root, per column."""

    def __init__(self, spec: Mapping[str, object] = CLAIM_UNSKEW, suffix: str = "_unskew"):
        self.spec, self.suffix = dict(spec), suffix

    def fit(self, df: DataFrame) -> UnskewModel:
        facts = column_facts(df, list(self.spec), {"min": F.min, "max": F.max})
        outs = [c + self.suffix for c in self.spec]
        return UnskewModel({"spec": self.spec, "outs": outs, "facts": facts})


def box_cox(x: Column, lam: float) -> Column:
    return F.log(x) if lam == 0 else (F.pow(x, F.lit(lam)) - 1) / F.lit(lam)


class BoxCoxModel(Fitted):
    def transform(self, df: DataFrame) -> DataFrame:
        p = self.params
        outs = {}
        for c, o in zip(p["cols"], p["outs"]):
            lam = p["lambdas"][c]
            outs[o] = F.col(c).cast("double") if lam is None else box_cox(F.col(c) + 1, lam)
        return df.withColumns(outs)


class BoxCoxSkewed:
    """Box-Cox of ``x + 1`` for columns with population skewness above ``threshold``; others stay.

    The likelihood has one peak, so a grid that narrows tenfold per pass finds
    it. Every pass evaluates the whole grid of all columns in one aggregation.
    """

    STEPS = 20

    def __init__(self, cols: Sequence[str], threshold: float = 0.25, resolution: float = 1e-6, bound: float = 5.0, suffix: str = "_boxcox"):
        self.cols, self.threshold, self.resolution = list(cols), threshold, resolution
        self.bound, self.suffix = bound, suffix

    def _likelihoods(self, df: DataFrame, grids: dict[str, list[float]]) -> dict[str, list[float]]:
        aggs = []
        for c, grid in grids.items():
            x = F.col(c).cast("double") + 1
            aggs += [F.sum(F.log(x)).alias(f"s|{c}"), F.count(c).alias(f"n|{c}")]
            for i, lam in enumerate(grid):
                shape = F.log(x) if lam == 0 else F.pow(x, F.lit(lam)) / F.lit(lam)
                aggs.append(F.log(F.var_pop(shape)).alias(f"{i}|{c}"))
        row = df.agg(*aggs).first()
        return {
            c: [
                float("-inf") if row[f"{i}|{c}"] is None else (lam - 1) * row[f"s|{c}"] - row[f"n|{c}"] / 2 * row[f"{i}|{c}"]
                for i, lam in enumerate(grid)
            ]
            for c, grid in grids.items()
        }

    def fit(self, df: DataFrame) -> BoxCoxModel:
        skewness = column_facts(df, self.cols, {"skew": F.skewness})
        wanted = [c for c in self.cols if (skewness[c]["skew"] or 0.0) > self.threshold]
        # whole multiples of the step keep the grid free of rounding drift
        step = self.resolution
        while step * self.STEPS / 2 < self.bound:
            step *= 10
        best = {c: 0 for c in wanted}  # in units of the step
        while wanted:
            half = self.STEPS // 2
            grids = {c: [(best[c] + i) * step for i in range(-half, half + 1)] for c in wanted}
            grids = {c: [round(v, 12) for v in g] for c, g in grids.items()}
            found = self._likelihoods(df, grids)
            at_edge = False
            for c in wanted:
                place = max(range(self.STEPS + 1), key=lambda i: found[c][i])
                best[c] += place - half
                at_edge = at_edge or place in (0, self.STEPS)
            if at_edge and max(abs(b) * step for b in best.values()) < 20 * self.bound:
                continue
            if step <= self.resolution * 1.5:
                break
            step /= 10
            best = {c: b * 10 for c, b in best.items()}
        lambdas = {c: round(best[c] * step, 12) if c in best else None for c in self.cols}
        outs = [c + self.suffix for c in self.cols]
        return BoxCoxModel({"cols": self.cols, "outs": outs, "lambdas": lambdas})


class RankGaussModel(Fitted):
    def transform(self, df: DataFrame) -> DataFrame:
        p = self.params
        df = map_columns(df, self.table, p["cols"], ["score"], self.small, as_type="double")
        return df.withColumnsRenamed({f"score|{c}": o for c, o in zip(p["cols"], p["outs"])})


class RankGauss:
    """Average rank, scaled into +-lim, through the inverse error function, then standard scaled.

    The score depends on the value alone, so the fitted state is a table of
    distinct values; ranks are computed over value ranges, not in one sort.
    """

    def __init__(self, cols: Sequence[str], lim: float = 0.999, key: str = "id", suffix: str = "_gauss"):
        self.cols, self.lim, self.key, self.suffix = list(cols), lim, key, suffix

    def fit(self, df: DataFrame) -> RankGaussModel:
        ranks = average_rank_of(ordered_counts_many(df, self.cols)).select("feature", "value", "cnt", "rank").persist()
        ends = ranks.groupBy("feature").agg(F.min("rank").alias("_lo"), F.max("rank").alias("_hi"))  # one row per column
        span = F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(F.lit(1.0))
        unit = (F.col("rank") - F.col("_lo")) / span * F.lit(2 * self.lim) - F.lit(self.lim)
        raw = ranks.join(F.broadcast(ends), "feature").withColumn("_u", unit).withColumn("_g", erfinv(F.col("_u")))
        # totals around the rank-symmetric zero, so the plain second moment is stable
        n, s1, s2 = F.sum("cnt"), F.sum(F.col("cnt") * F.col("_g")), F.sum(F.col("cnt") * F.col("_g") * F.col("_g"))
        facts = raw.groupBy("feature").agg((s1 / n).alias("_mean"), F.sqrt(s2 / n - (s1 / n) * (s1 / n)).alias("_std"))
        std = F.when(F.col("_std") > 0, F.col("_std")).otherwise(F.lit(1.0))
        score = (F.col("_g") - F.col("_mean")) / std
        table = raw.join(F.broadcast(facts), "feature").select("feature", "value", score.alias("score"), "cnt")
        table = settle(table)
        ranks.unpersist()
        params = {"cols": self.cols, "outs": [c + self.suffix for c in self.cols], "key": self.key}
        return RankGaussModel(params, table)
