"""Scores of predictions, and corrections searched on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from foldwise.operators.ordering import average_rank_of, ordered_counts
from foldwise.operators.aggregates import quantile_edges
from foldwise.operators.rows import kfold


def mae(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.abs(F.col(p) - F.col(y))).alias("mae"))


def fold_mae(df: DataFrame, y: str, p: str, fold: str) -> DataFrame:
    """One row: overall error, mean and population std over folds."""
    parts = df.groupBy(fold).agg(
        F.sum(F.abs(F.col(p) - F.col(y))).alias("_s"), F.count(p).alias("_n"), F.avg(F.abs(F.col(p) - F.col(y))).alias("_m")
    )
    return parts.agg(
        (F.sum("_s") / F.sum("_n")).alias("mae"), F.avg("_m").alias("mae_mean"), F.stddev_pop("_m").alias("mae_std")
    )


def confusion(df: DataFrame, y: str, p: str) -> DataFrame:
    """(true, predicted, n)."""
    return df.groupBy(F.col(y).alias("true"), F.col(p).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def match_flag(df: DataFrame, y: str, p: str, out: str = "same") -> DataFrame:
    """The true class where the prediction is right, else -1."""
    return df.withColumn(out, F.when(F.col(y) == F.col(p), F.col(y)).otherwise(F.lit(-1)))


def class_f1(df: DataFrame, y: str, p: str) -> DataFrame:
    """(class, support, f1); f1 is 0 when undefined. Works on the confusion counts."""
    cells = confusion(df, y, p)
    actual = cells.groupBy(F.col("true").alias("class")).agg(
        F.sum("n").alias("support"), F.sum(F.when(F.col("true") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hits")
    )
    guessed = cells.groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("guessed"))
    both = actual.join(guessed, "class", "left")
    f1 = 2 * F.col("hits") / (F.col("support") + F.coalesce("guessed", F.lit(0)))
    return both.select("class", "support", F.coalesce(f1, F.lit(0.0)).alias("f1"))


def weighted_f1(df: DataFrame, y: str, p: str) -> DataFrame:
    """Mean class F1 weighted by the true counts."""
    return class_f1(df, y, p).agg((F.sum(F.col("support") * F.col("f1")) / F.sum("support")).alias("weighted_f1"))


def log_loss(df: DataFrame, y: str, probs: Sequence[str], eps: float = 1e-15) -> DataFrame:
    """Multiclass log loss; rows are scaled to one, then clipped."""
    total = sum((F.col(c) for c in probs), F.lit(0.0))
    own = F.element_at(F.array(*probs), F.col(y).cast("int") + 1) / total
    bounded = F.least(F.greatest(own, F.lit(eps)), F.lit(1 - eps))
    return df.agg(F.avg(-F.log(bounded)).alias("log_loss"))


def auc(df: DataFrame, y: str, s: str, by: Sequence[str] = ()) -> DataFrame:
    """Exact area under the ROC curve from rank sums with ties averaged, and 2*AUC-1; null with one class."""
    by = list(by)
    rows = df.select(*by, F.col(s).cast("double").alias("_s"), F.col(y).cast("long").alias("_y"))
    ranks = average_rank_of(ordered_counts(rows, "_s", by, extra={"hits": F.sum("_y")}))
    facts = ranks.groupBy(*by).agg(
        F.sum("hits").alias("n1"), F.sum("cnt").alias("n"), F.sum(F.col("hits") * F.col("rank")).alias("r")
    )
    n1, n0 = F.col("n1"), F.col("n") - F.col("n1")
    area = (F.col("r") - n1 * (n1 + 1) / 2) / F.nullif((n1 * n0).cast("double"), F.lit(0.0))
    return facts.select(*by, area.alias("auc"), (2 * area - 1).alias("gini"))


def batch_f1(df: DataFrame, ys: Sequence[str], ps: Sequence[str], eps: float = 1e-7) -> DataFrame:
    """Precision, recall and F1 over all cells of rounded, clipped products."""

    def clipped(c: Column) -> Column:
        # halves round to the even number
        return F.bround(F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0)), 0)

    def total(cells):
        return sum((F.sum(clipped(c)) for c in cells), F.lit(0.0))

    hits = total([F.col(y) * F.col(p) for y, p in zip(ys, ps)])
    one = df.agg(hits.alias("_tp"), total([F.col(p) for p in ps]).alias("_pp"), total([F.col(y) for y in ys]).alias("_pos"))
    precision = F.col("_tp") / (F.col("_pp") + eps)
    recall = F.col("_tp") / (F.col("_pos") + eps)
    f1 = 2 * precision * recall / (precision + recall + eps)
    return one.select(precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def bucket_mae(df: DataFrame, y: str, p: str, qs: Sequence[float] = (0.2, 0.4, 0.6, 0.8)) -> DataFrame:
    """Error per bucket of the target: the first quantile edge not below the target, else the last bucket."""
    edges = quantile_edges(df, y, qs).first()  # one row
    bucket = F.lit(len(qs))
    for i in reversed(range(len(qs))):
        bucket = F.when(F.col(y) <= F.lit(edges[f"q{i}"]), F.lit(i)).otherwise(bucket)
    return df.groupBy(bucket.alias("bucket")).agg(F.avg(F.abs(F.col(p) - F.col(y))).alias("mae"))


# fixed values: first exponent, the steps, and how many steps to each side
POWER_START, POWER_STEPS, POWER_REACH = 1.02, (0.01, 0.001), 9


def power_search(df: DataFrame, y: str, p: str, start: float = POWER_START) -> DataFrame:
    """(step, power, mae): all exponents of a pass in one aggregation; the second pass is around the best of the first.

    The corrected prediction is ``p**e / mean(p)**(e-1)``.
    """
    mean = df.agg(F.avg(p)).first()[0]
    rows, current = [], start
    for step in POWER_STEPS:
        powers = [round(current + i * step, 10) for i in range(-POWER_REACH, POWER_REACH + 1)]
        errors = df.agg(
            *[F.avg(F.abs(F.pow(F.col(p), F.lit(e)) / F.lit(mean ** (e - 1)) - F.col(y))).alias(f"e{i}") for i, e in enumerate(powers)]
        ).first()
        found = [(step, e, errors[f"e{i}"]) for i, e in enumerate(powers)]
        rows += found
        current = min(found, key=lambda r: (r[2], r[1]))[1]
    return df.sparkSession.createDataFrame(rows, "step double, power double, mae double")


def qr_correction(df: DataFrame, key: str, y: str, p: str, k: int = 8, seed=2016) -> DataFrame:
    """(fold, orig_mae, corr_mae): the median slope fitted on the other folds, applied to the fold."""
    from foldwise.plans.learners import MedianRegression

    rows = kfold(df, key, k, seed).persist()
    slopes = [MedianRegression().fit(rows.filter(F.col("fold") != f), [p], y).coefficients[0] for f in range(k)]
    slope = F.element_at(F.array(*[F.lit(s) for s in slopes]), F.col("fold") + 1)
    done = rows.groupBy("fold").agg(
        F.avg(F.abs(F.col(p) - F.col(y))).alias("orig_mae"), F.avg(F.abs(F.col(p) * slope - F.col(y))).alias("corr_mae")
    )
    return done


def robust_residuals(df: DataFrame, y: str, p: str, h: float = 1.0, c: float = 1.0, decay: float = 0.0, round_no: int = 0) -> DataFrame:
    """Gradients and curvatures of the pseudo-Huber and the Fair loss per row."""
    import math

    d = F.col(p) - F.col(y)
    scale = 1 + (d / F.lit(float(h))) * (d / F.lit(float(h)))
    fair = F.abs(d) * F.lit(math.exp(decay * round_no)) + F.lit(float(c))
    return df.withColumns(
        {
            "huber_grad": d / F.sqrt(scale),
            "huber_hess": 1 / scale / F.sqrt(scale),
            "fair_grad": F.lit(float(c)) * d / fair,
            "fair_hess": F.lit(float(c * c)) / (fair * fair),
        }
    )
