"""Out-of-fold prediction, bagging, prediction tables, stacking and blending."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from foldwise.encoders.base import map_columns
from foldwise.encoders.categorical import TargetMean, TargetMeanModel
from foldwise.encoders.projection import TruncatedSvd
from foldwise.functions.numeric import argmax, target_transform
from foldwise.operators.aggregates import target_stats
from foldwise.operators.rows import kfold, sample_columns, sample_exact, stratified_kfold
from foldwise.session import settle, settled
from foldwise.sources.predictions import PARTS, find_run, load_prediction, save_predictions, value_columns


def assemble_inputs(
    parts: Sequence[DataFrame],
    predictions: Mapping[str, DataFrame],
    key: str,
    clip: float = 0.1,
    transform: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Feature parts and clipped, optionally reshaped predictions side by side.

    A single value takes the name of its prediction, class columns are called
    ``<name>_<class column>``.
    """
    shape = transform or (lambda c: c)
    columns = []
    for name, d in predictions.items():
        values = value_columns(d, key)
        names = [name] if len(values) == 1 else [f"{name}_{v}" for v in values]
        columns.append(d.select(key, *[shape(F.greatest(F.col(v), F.lit(clip))).alias(n) for v, n in zip(values, names)]))
    return reduce(lambda a, b: a.join(b, key), [*parts, *columns])


def prediction_names(specs: Sequence) -> list[str]:
    """One name per spec: that of its preset, ``pred_1``, ``pred_2``, ... for lists, and the name with its power."""
    names, lists = [], 0
    for spec in specs:
        base, suffix = (spec[0], f"^{spec[1]['power']}") if isinstance(spec, tuple) else (spec, "")
        if isinstance(base, list):
            lists += 1
            base = f"pred_{lists}"
        names.append(f"{base}{suffix}".replace(".", "_"))
    return names


def presets_in(spec) -> list[str]:
    """The presets whose runs a spec needs."""
    if isinstance(spec, tuple):
        return presets_in(spec[0])
    if isinstance(spec, list):
        return [name for s in spec for name in presets_in(s)]
    return [spec]


def with_powers(df: DataFrame, cols: Sequence[str], powers: Sequence[float]) -> tuple[DataFrame, list[str]]:
    """Adds every column raised to each power; returns the table and all names."""
    made = {f"{c}^{p}".replace(".", "_"): F.pow(c, F.lit(float(p))) for p in powers for c in cols}
    return df.withColumns(made), [*cols, *made]


@dataclass(frozen=True)
class Preset:
    """What one model run needs: inputs, learner, target transform, sampling.

    ``predictions`` are outputs of earlier runs taken as inputs: the name of a
    preset, a list of specs (their mean), or (spec, {"power": p}). They are
    clipped below, reshaped by ``prediction_transform`` (a name and its
    arguments, as for ``transform``), and joined on the key; ``powers`` adds
    every input column raised to each power. ``predictions_mode`` says which
    test predictions of the earlier runs are read.
    """

    name: str
    features: tuple[str, ...]
    estimator: object
    predictions: tuple = ()
    predictions_mode: str = "fulltrain"
    prediction_transform: tuple | None = None
    powers: tuple[float, ...] = ()
    n_splits: int = 1
    n_bags: int = 1
    target: str = "loss"
    key: str = "id"
    transform: tuple = ("identity",)
    encoders: tuple = ()
    sample: float | None = None
    feature_sample: float | None = None
    svd: int | None = None
    agg: str = "mean"
    order: str = "inverse_first"
    classes: int | None = None
    rounds: str | None = None
    options: dict = field(default_factory=dict)

    def transforms(self):
        return target_transform(*self.transform)

    def value_columns(self) -> list[str]:
        return ["value"] if self.classes is None else [f"c{i}" for i in range(self.classes)]


@dataclass(frozen=True)
class Bag:
    """One bag: the rows to fit on, its columns, and how any table becomes its input vector."""

    train: DataFrame
    columns: tuple[str, ...]
    prepare: Callable[[DataFrame], DataFrame]


def bag(df: DataFrame, cols: Sequence[str], key: str, frac=None, col_frac=None, svd=None, seed=42) -> Bag:
    """Row sample, column sample, and an SVD fitted on the sampled rows."""
    rows = df if frac is None else sample_exact(df, key, frac, seed)
    chosen = tuple(cols) if col_frac is None else tuple(sample_columns(cols, col_frac, seed))
    if svd is not None:
        model = TruncatedSvd(list(chosen), svd, "_bag_svd").fit(rows)
        vector = VectorAssembler(inputCols=model.feature_names(), outputCol="features")

        def prepare(d: DataFrame) -> DataFrame:
            return vector.transform(model.transform(d)).drop(*model.feature_names())

    else:
        vector = VectorAssembler(inputCols=list(chosen), outputCol="features", handleInvalid="error")

        def prepare(d: DataFrame) -> DataFrame:
            return vector.transform(d)

    return Bag(rows, chosen, prepare)


# name of the column in which the target of a training row goes along with its prediction
TRUTH = "_truth"
# tables with one text key a row
KEYED = "zstd"


def fit_predict(preset: Preset, made: Bag, tables: Mapping[str, DataFrame], seed: int, rounds_factor: float = 1.0) -> dict[str, DataFrame]:
    """Fits the learner on the transformed target of the bag and predicts every table: (key, value or c0..cn, the truth if it has it)."""
    forward, _ = preset.transforms()
    train = made.prepare(made.train).select(
        "features", forward(F.col(preset.target).cast("double")).alias("label"), *preset.options.get("keep", ())
    )
    learner = preset.estimator.copy()
    if learner.hasParam("seed"):
        learner = learner.copy({learner.getParam("seed"): seed})
    if preset.rounds and rounds_factor != 1.0:
        param = learner.getParam(preset.rounds)
        learner = learner.copy({param: int(learner.getOrDefault(param) * rounds_factor)})
    model = learner.fit(train)

    def predict(d: DataFrame) -> DataFrame:
        scored = model.transform(made.prepare(d))
        along = [TRUTH] if TRUTH in d.columns else []
        if preset.classes is None:
            return scored.select(preset.key, F.col("prediction").alias("value"), *along)
        if "probability" in scored.columns:
            values = vector_to_array("probability")
        else:
            raw = F.transform(vector_to_array("rawPrediction"), lambda x: 1 / (1 + F.exp(-x)))
            total = F.aggregate(raw, F.lit(0.0), lambda a, x: a + x)
            values = F.transform(raw, lambda x: x / total)
        # a class that no training row had comes back as a short vector
        return scored.select(preset.key, *[F.coalesce(F.get(values, F.lit(i)), F.lit(0.0)).alias(f"c{i}") for i in range(preset.classes)], *along)

    return {n: predict(d) for n, d in tables.items()}


def oof_predict(
    train: DataFrame,
    test: DataFrame | None,
    preset: Preset,
    k: int = 5,
    n_splits: int = 1,
    n_bags: int = 1,
    full: bool = True,
    fold_of: Callable[[DataFrame, int], DataFrame] | None = None,
) -> DataFrame:
    """Raw predictions (part, split, fold, bag, key, value): every training row is predicted by models that did not see it.

    ``train`` holds the out-of-fold rows, ``test-foldavg`` the test rows per
    fold model, ``test-fulltrain`` the test rows of a refit on all rows, with
    the rounds scaled by k/(k-1).
    """
    # every fold reads the training rows several times, and each of its models the test rows
    return _oof_of_tables(settle(train, KEYED), None if test is None else settle(test, KEYED), preset, k, n_splits, n_bags, full, fold_of)


def _oof_of_tables(train, test, preset: Preset, k: int, n_splits: int, n_bags: int, full: bool, fold_of, truth: bool = False) -> DataFrame:
    """``oof_predict`` of tables that are computed already; with ``truth`` the target of the training rows goes along."""
    assign = fold_of or (lambda d, split: kfold(d, preset.key, k, 2016 + 17 * split))
    pieces = []

    def add(d: DataFrame, part: str, split: int, fold: int, number: int):
        tags = [F.lit(v).alias(n) for n, v in (("part", part), ("split", split), ("fold", fold), ("bag", number))]
        pieces.append(d.select(*tags, *d.columns))

    def built(fit_rows, tables):
        cols = list(preset.features)
        made_train, made = fit_rows, dict(tables)
        for encoder in preset.encoders:
            model = encoder.fit(made_train)
            made_train = model.transform_fitted(made_train) if hasattr(model, "transform_fitted") else model.transform(made_train)
            made = {n: model.transform(d) for n, d in made.items()}
            cols += model.feature_names()
        return made_train, made, cols

    def sampled(rows, cols, seed):
        return bag(rows, cols, preset.key, preset.sample, preset.feature_sample, preset.svd, seed)

    for split in range(n_splits):
        folded = assign(train, split)
        if fold_of is not None:
            # folds that need a shuffle are dealt once; a hash of the key is computed again
            folded = settle(folded, KEYED)
        for fold in range(k):
            held = folded.filter(F.col("fold") == fold).drop("fold")
            tables = {"train": held.withColumn(TRUTH, F.col(preset.target)) if truth else held}
            if test is not None:
                tables["test-foldavg"] = test
            rows, made, cols = built(folded.filter(F.col("fold") != fold).drop("fold"), tables)
            for number in range(n_bags):
                found = fit_predict(preset, sampled(rows, cols, 42 + 11 * split + 13 * fold + 17 * number), made, 42 + 11 * split + 17 * fold + 13 * number)
                for part, d in found.items():
                    add(d, part, split, fold, number)
    if full and test is not None:
        rows, made, cols = built(train, {"test-fulltrain": test})
        for number in range(n_bags):
            found = fit_predict(preset, sampled(rows, cols, 42 + 17 * number), made, 42 + 13 * number, k / (k - 1.0))
            add(found["test-fulltrain"], "test-fulltrain", 0, 0, number)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=truth), pieces)


def holdout_predict(train: DataFrame, tables: Mapping[str, DataFrame], preset: Preset, seed: int = 42) -> dict[str, DataFrame]:
    """One fit on ``train``; predictions for a validation part and any other table."""
    cols = list(preset.features)
    rows, made = settle(train), dict(tables)
    for encoder in preset.encoders:
        model = encoder.fit(rows)
        rows = model.transform_fitted(rows) if hasattr(model, "transform_fitted") else model.transform(rows)
        made = {n: model.transform(d) for n, d in made.items()}
        cols += model.feature_names()
    sampled = bag(rows, cols, preset.key, preset.sample, preset.feature_sample, preset.svd, seed)
    return fit_predict(preset, sampled, made, seed)


def run_name(preset: Preset, score: float, moment: str) -> str:
    """``<time>-<preset>-<score>``."""
    return f"{moment}-{preset.name}-{score:.5f}"


def train_run(
    train: DataFrame,
    test: DataFrame,
    preset: Preset,
    root: str,
    moment: str,
    k: int = 5,
    n_splits: int | None = None,
    n_bags: int | None = None,
) -> tuple[str, dict]:
    """Out-of-fold predictions, their score, and the three prediction parts saved under a name that carries it.

    Values or class probabilities go through the inverse target transform and
    the mean or median over folds and bags. Regression presets are scored by
    the mean absolute error; class presets by the weighted F1 of the arg-max,
    overall and per fold, with stratified folds.
    """
    n_splits, n_bags = n_splits or preset.n_splits, n_bags or preset.n_bags
    values = preset.value_columns()
    fold_of = None
    if preset.classes is not None:
        fold_of = lambda d, split: stratified_kfold(d, preset.key, preset.target, k, 2019 + 17 * split)
    _, back = preset.transforms()
    # the folds read the tables several times; they and the values go when the parts are saved
    with settled(train, KEYED) as rows, settled(test, KEYED) as others:
        raw = _oof_of_tables(rows, others, preset, k, n_splits, n_bags, True, fold_of, truth=True)
        with settled(_judged(raw, preset, back, values), KEYED) as final:
            score, mean, std, name = _scores(final, preset, values, preset.key)
            run = run_name(preset, score, moment)
            for part in PARTS:
                save_predictions(final.filter(F.col("part") == part).select(preset.key, *values), root, run, part)
    return run, {name: score, f"{name}_mean": mean, f"{name}_std": std}


def _judged(raw: DataFrame, preset: Preset, back: Callable[[Column], Column], values: Sequence[str]) -> DataFrame:
    """(part, key, values); training keys also have ``_own``, their values by split and fold, and ``_truths``, the targets of their rows.

    The predictions of a key meet once, and no other table is joined to them: raw predictions are the largest table of a run.
    """
    found = F.collect_list(F.struct("split", "fold", "bag", TRUTH, *values))
    met = raw.repartition("part", preset.key).groupBy("part", preset.key).agg(found.alias("_found"))

    def of_field(of: Column, name: str) -> Column:
        return F.transform(of, lambda x: x[name])

    def combined(of: Column) -> list[Column]:
        return [_of_list(of_field(of, v), preset.agg, back, preset.order).alias(v) for v in values]

    def own(at: Column) -> Column:
        here = F.filter("_found", lambda x: (x["split"] == at["split"]) & (x["fold"] == at["fold"]))
        return F.struct(at["split"].alias("split"), at["fold"].alias("fold"), *combined(here))

    places = F.array_distinct(F.transform("_found", lambda x: F.struct(x["split"].alias("split"), x["fold"].alias("fold"))))
    # every training row is in one fold of a split
    once = F.filter("_found", lambda x: (x["split"] == 0) & (x["bag"] == 0))
    judged = (F.col("part") == "train") & F.col(preset.key).isNotNull()
    return met.select(
        "part",
        preset.key,
        *combined(F.col("_found")),
        F.when(judged, F.transform(places, own)).alias("_own"),
        F.when(judged, of_field(once, TRUTH)).alias("_truths"),
    )


def _scores(final: DataFrame, preset: Preset, values: Sequence[str], key: str) -> tuple[float, float, float, str]:
    """Score of all training rows, mean and deviation over splits and folds, and the name of the score."""
    rows = final.filter("_own is not null")
    whole = F.struct(F.lit(None).cast("int").alias("split"), F.lit(None).cast("int").alias("fold"), *values)
    every = rows.select(F.explode(F.concat(F.array(whole), "_own")).alias("_o"), "_truths")
    found = every.select("_o.*", F.explode("_truths").alias(TRUTH))
    if preset.classes is None:
        name = "mae"
        table = found.groupBy("split", "fold").agg(F.avg(F.abs(F.col("value") - F.col(TRUTH))).alias("m"))
    else:
        name = "f1"
        table = f1_by(found.withColumn("_guess", argmax(values)), TRUTH, "_guess", ("split", "fold")).withColumnRenamed("weighted_f1", "m")
    score, mean, std = table.agg(
        F.max(F.when(F.col("split").isNull(), F.col("m"))),
        F.avg(F.when(F.col("split").isNotNull(), F.col("m"))),
        F.stddev_pop(F.when(F.col("split").isNotNull(), F.col("m"))),
    ).first()
    return score, mean, std, name


def f1_by(df: DataFrame, label: str, guess: str, by: Sequence[str]) -> DataFrame:
    """(by, weighted_f1): mean class F1 weighted by the true counts, from the confusion counts of each group."""
    cells = df.groupBy(*by, F.col(label).alias("_y"), F.col(guess).alias("_g")).agg(F.count(F.lit(1)).alias("_n"))
    hits = F.when(F.col("_y") == F.col("_g"), F.col("_n")).otherwise(F.lit(0))
    both = F.explode(F.array(F.struct(F.col("_y").alias("c"), F.col("_n").alias("s"), F.lit(0).cast("long").alias("g")), F.struct(F.col("_g").alias("c"), F.lit(0).cast("long").alias("s"), F.col("_n").alias("g"))))
    rows = cells.select(*by, both.alias("_b"), hits.alias("_h"))
    # each cell counts once for its true and once for its guessed class; hits are taken from the true side
    per = rows.groupBy(*by, "_b.c").agg(
        F.sum("_b.s").alias("_s"), F.sum("_b.g").alias("_p"), F.sum(F.when(F.col("_b.s") > 0, F.col("_h")).otherwise(F.lit(0))).alias("_hit")
    )
    f1 = F.when(F.col("_s") + F.col("_p") > 0, 2 * F.col("_hit") / (F.col("_s") + F.col("_p"))).otherwise(F.lit(0.0))
    return per.groupBy(*by).agg((F.sum(F.col("_s") * f1) / F.sum("_s")).alias("weighted_f1"))


def run_presets(
    train: DataFrame,
    test: DataFrame,
    presets: Mapping[str, Preset],
    wanted: Sequence[str],
    root: str,
    moment: str,
    k: int = 5,
) -> dict[str, str]:
    """Runs presets after the presets whose predictions they take; returns the name of each run.

    A preset of a later level sees the out-of-fold predictions of the training
    rows and the full-train or fold-mean predictions of the test rows.
    """
    done: dict[str, str] = {}

    def visit(name: str, above: tuple[str, ...]) -> None:
        if name in done:
            return
        if name in above:
            raise ValueError(f"presets need each other: {' -> '.join((*above, name))}")
        preset = presets[name]
        for spec in preset.predictions:
            for needed in presets_in(spec):
                visit(needed, (*above, name))
        rows, others, inputs = level_inputs(train, test, preset, root)
        done[name], _ = train_run(rows, others, replace(preset, features=tuple(inputs)), root, moment, k)

    for name in wanted:
        visit(name, ())
    return done


def level_inputs(train: DataFrame, test: DataFrame, preset: Preset, root: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """Training and test tables of a preset with the predictions it takes and the powers, and the input names."""
    spark = train.sparkSession
    shape = target_transform(*preset.prediction_transform)[0] if preset.prediction_transform else None

    def resolved(spec):
        if isinstance(spec, tuple):
            return resolved(spec[0]), spec[1]
        return [resolved(s) for s in spec] if isinstance(spec, list) else find_run(spark, root, spec)

    def made(df: DataFrame, part: str):
        tables = {
            name: load_prediction(spark, root, resolved(spec), part, preset.predictions_mode, preset.key)
            for name, spec in zip(prediction_names(preset.predictions), preset.predictions)
        }
        rows = assemble_inputs([df], tables, preset.key, transform=shape)
        cols = [*preset.features, *[c for c in rows.columns if c not in df.columns]]
        return with_powers(rows, cols, preset.powers)

    rows, inputs = made(train, "train")
    others, _ = made(test, "test")
    return rows, others, inputs


def _of_list(values: Column, agg: str, back: Callable[[Column], Column], order: str) -> Column:
    """Mean or median of the few values of one key, before or after the inverse target transform; nulls do not count.

    The median is taken from a sorted list, which takes far less memory per key than a table of counts.
    """
    first, last = (back, lambda c: c) if order == "inverse_first" else (lambda c: c, back)
    found = F.filter(F.transform(values, lambda x: first(x).cast("double")), lambda x: x.isNotNull())
    n = F.size(found)
    if agg == "mean":
        return last(F.when(n > 0, F.aggregate(found, F.lit(0.0), lambda a, x: a + x) / n))
    ranked = F.array_sort(found)
    low, high = F.get(ranked, F.floor((n - 1) / 2).cast("int")), F.get(ranked, F.floor(n / 2).cast("int"))
    return last(F.when(low == high, low).otherwise(0.5 * low + 0.5 * high))


def aggregate_predictions(
    p: DataFrame,
    key: str = "id",
    agg: str | Mapping[str, tuple[str, str]] = "mean",
    inverse: Callable[[Column], Column] | None = None,
    order: str = "inverse_first",
    by: Sequence[str] = ("part",),
    value: str | Sequence[str] = "value",
) -> DataFrame:
    """One row per key: mean or median over folds and bags of each value column, before or after the inverse target transform.

    ``inverse_first`` is transform-mean and transform-median, ``agg_first`` is mean-transform. Several forms of one value
    column are named: ``{name: (agg, order)}`` gives a column for each, and the predictions of a key meet once for all.
    """
    back = inverse or (lambda c: c)
    values = [value] if isinstance(value, str) else list(value)
    forms = {v: (v, agg, order) for v in values} if isinstance(agg, str) else {n: (values[0], *form) for n, form in agg.items()}
    # rows are sent as they are: a task seldom has a key twice, and a list of one value takes more than the value
    met = p.select(*by, key, *values).repartition(*by, key).groupBy(*by, key)
    lists = met.agg(*[F.collect_list(v).alias(f"_v_{v}") for v in values])
    return lists.select(*by, key, *[_of_list(F.col(f"_v_{v}"), a, back, o).alias(n) for n, (v, a, o) in forms.items()])


def stack(p: DataFrame, key: str, runs: Sequence[str], run_col: str = "run", value: str = "value") -> DataFrame:
    """(key, one column per run): the inputs of the next level."""
    return p.groupBy(key).agg(*[F.max(F.when(F.col(run_col) == r, F.col(value))).alias(r) for r in runs])


def blend(p: DataFrame, key: str, weights: Mapping[str, float], run_col: str = "run", value: str = "value") -> DataFrame:
    """Weighted mean over runs; a run listed twice has weight 2."""
    weight = None
    for run, w in weights.items():
        hit = F.col(run_col) == run
        weight = F.when(hit, float(w)) if weight is None else weight.when(hit, float(w))
    rows = p.withColumn("_w", weight).filter("_w is not null")
    return rows.groupBy(key).agg((F.sum(F.col("_w") * F.col(value)) / F.sum("_w")).alias(value))


# fixed values: the classes that may be overridden, the threshold and the class taken instead
OVERRIDE_CLASSES = tuple(range(1, 11))


def override_low_confidence(
    p: DataFrame, scores: Sequence[str], classes: Sequence[int] = OVERRIDE_CLASSES, threshold: float = 0.4, to: int = 0, out: str = "click_mode"
) -> DataFrame:
    """Arg-max class, replaced by ``to`` when its score is below the threshold; ``changed`` marks such rows."""
    best = argmax(scores)
    rows = p.withColumn("_best", best).withColumn("_score", F.greatest(*scores) if len(scores) > 1 else F.col(scores[0]))
    weak = F.col("_best").isin(list(classes)) & (F.col("_score") < threshold)
    return rows.withColumn(out, F.when(weak, F.lit(to)).otherwise(F.col("_best"))).withColumn("changed", weak.cast("int")).drop("_best", "_score")


def fold_encode(df: DataFrame, encoder: TargetMean, fold: str = "fold") -> DataFrame:
    """Target means of every row from the rows of the other folds.

    One pass over the data: statistics per fold and value; what a fold must not
    see is taken off the totals. The table has one row per fold and value.
    """
    rows, cols = encoder.prepared(df)
    stats = settle(target_stats(rows, cols, "_t", [fold]))
    # the values of one column, null among them, add up to the fold
    whole = stats.filter(F.col("feature") == cols[0]).groupBy(fold).agg(F.sum("target_sum").alias("s"), F.sum("cnt").alias("n"))
    parts = whole.collect()  # one row per fold
    own = stats.filter("value is not null")
    total = own.groupBy("feature", "value").agg(F.sum("target_sum").alias("_s"), F.sum("cnt").alias("_n"))
    folds = [r[fold] for r in parts]
    numbers = F.array(*[F.lit(f).cast(df.schema[fold].dataType) for f in folds])
    every = total.withColumn(fold, F.explode(numbers))
    table = every.join(own, [fold, "feature", "value"], "left").select(
        fold,
        "feature",
        "value",
        (F.col("_s") - F.coalesce("target_sum", F.lit(0.0))).alias("target_sum"),
        (F.col("_n") - F.coalesce("cnt", F.lit(0))).alias("cnt"),
    )
    model = TargetMeanModel(encoder._params(cols, {"mean": 0.0, "std": 0.0}, [fold]), settle(table))
    sums, n = sum(r["s"] for r in parts), sum(r["n"] for r in parts)
    mean = F.coalesce(*[F.when(F.col(fold) == r[fold], F.lit((sums - r["s"]) / (n - r["n"]))) for r in parts])
    mapped = map_columns(rows, model.table, cols, ["target_sum", "cnt"], model.small, [fold])
    mapped = mapped.withColumn("_prior", mean * F.lit(float(encoder.C)))
    return model._finish(mapped, lambda c: F.col("_prior"), None).drop("_t", "_prior")
