"""Labelled batches in order: a sliding window, encoders over window and new batch, predict then learn.

The window is a table in the shared folder, partitioned by batch number and,
below it, by the micro-batch that brought the rows. A batch may arrive in any
number of micro-batches: each writes by replacing its own part, so its rows add
up and a repeated micro-batch changes nothing. The window is the last batches
seen, whatever their numbers. Batches that left it are not read, and a running
query removes them.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from foldwise.encoders.categorical import FrequencyEncode, MultiValueEncode
from foldwise.operators.aggregates import frequencies
from foldwise.operators.clean import DropSparse
from foldwise.session import paths_like, remove_folder

# fixed value: batches kept in the window
WINDOW = 3


def _last_batches(df: DataFrame, current: int, size: int) -> list[int]:
    """The numbers of the last ``size`` batches before ``current`` that are there; numbers may be missing."""
    numbers = df.filter(F.col("batch_no") < current).select("batch_no").distinct()
    return [r["batch_no"] for r in numbers.orderBy(F.desc("batch_no")).limit(size).collect()]


# name of the partition column for the micro-batch that brought the rows
MICRO = "micro_batch"


def _append(df: DataFrame, path: str, batch_no: int, micro: int) -> None:
    """Writes one part of a batch in place of the same part written before."""
    marked = df.withColumns({"batch_no": F.lit(batch_no), MICRO: F.lit(micro)})
    marked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_no", MICRO).parquet(path)


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.parquet(path) if paths_like(spark, f"{path}/batch_no=*") else None


class BatchWindow:
    """The last ``size`` labelled batches."""

    def __init__(self, root: str, size: int = WINDOW, part: str = "window"):
        self.path, self.size = f"{root}/{part}", size

    def push(self, df: DataFrame, batch_no: int, micro: int = 0) -> None:
        """Adds the rows of a batch that the micro-batch ``micro`` brought; pushed again they replace themselves."""
        _append(df, self.path, batch_no, micro)

    def read(self, spark: SparkSession, current: int) -> DataFrame | None:
        """The last ``size`` batches before ``current``, whatever their numbers; None before the first one."""
        df = _stored(spark, self.path)
        return None if df is None else df.filter(F.col("batch_no").isin(_last_batches(df, current, self.size))).drop(MICRO)

    def earlier_parts(self, spark: SparkSession, batch_no: int, micro: int) -> DataFrame | None:
        """The rows of a batch that micro-batches before ``micro`` brought."""
        df = _stored(spark, self.path)
        return None if df is None else df.filter((F.col("batch_no") == batch_no) & (F.col(MICRO) < micro)).drop("batch_no", MICRO)

    def expire(self, spark: SparkSession, current: int) -> None:
        """Removes the batches that are older than the window before ``current``.

        Call it before a micro-batch with that micro-batch's smallest number: a repetition then finds all it needs.
        """
        df = _stored(spark, self.path)
        kept = [] if df is None else _last_batches(df, current, self.size)
        if len(kept) == self.size:
            for folder in paths_like(spark, f"{self.path}/batch_no=*"):
                if int(folder.rpartition("=")[2]) < min(kept):
                    remove_folder(spark, folder)


def encode_window(
    window: DataFrame | None,
    batch: DataFrame,
    cat: Sequence[str],
    mv: Sequence[str] = (),
    max_cat_num: int = 1000,
    key: str = "id",
) -> tuple[DataFrame | None, DataFrame]:
    """Counts of categories and ranks of tokens over window and batch together; (encoded window, encoded batch)."""
    together = batch.select(*cat, *mv) if window is None else window.select(*cat, *mv).unionByName(batch.select(*cat, *mv))
    models = []
    if cat:
        models.append(FrequencyEncode(cat, null="-1", key=key).fit(together))
    models += [MultiValueEncode(c, max_cat_num).fit(together) for c in mv]

    def apply(df):
        for m in models:
            df = m.transform(df)
        return df

    return (None if window is None else apply(window)), apply(batch)


class FitOnceCleaner:
    """The choice of columns made on the first batch and kept in the shared folder for all later ones."""

    def __init__(self, root: str, max_null: float = 0.9):
        self.path, self.max_null = f"{root}/cleaner", max_null

    def columns(self, spark: SparkSession, first: DataFrame, cols: Sequence[str]) -> list[str]:
        if paths_like(spark, f"{self.path}/_SUCCESS"):
            return json.loads(spark.read.text(self.path).first()[0])
        chosen = DropSparse(self.max_null).fit(first, cols).columns
        spark.createDataFrame([(json.dumps(chosen),)], "value string").coalesce(1).write.mode("overwrite").text(self.path)
        return chosen

    def transform(self, df: DataFrame, cols: Sequence[str], keep: Sequence[str]) -> DataFrame:
        chosen = self.columns(df.sparkSession, df, cols)
        kinds = dict(df.dtypes)
        filled = []
        for c in chosen:
            if kinds[c] in ("double", "float"):  # not a number counts as missing
                filled.append(F.coalesce(F.nanvl(F.col(c), F.lit(None)), F.lit(0)).cast("double").alias(c))
            elif kinds[c] in ("int", "bigint"):
                filled.append(F.coalesce(F.col(c), F.lit(0)).cast("double").alias(c))
            else:
                filled.append(F.col(c))
        return df.select(*keep, *filled)


def fit_once_cleaner(root: str, max_null: float = 0.9) -> FitOnceCleaner:
    return FitOnceCleaner(root, max_null)


def each_batch(
    handle: Callable[[DataFrame, int, int], None],
    batch_col: str = "batch_no",
    before: Callable[[SparkSession, int], None] | None = None,
):
    """A ``foreachBatch`` function that hands on the labelled batches of a micro-batch in order.

    ``handle`` gets the rows, the batch number and the number of the micro-batch. ``before`` is called once for each
    micro-batch, with its smallest batch number.
    """

    def run(micro: DataFrame, epoch: int) -> None:
        kept = micro.persist()
        # batch numbers inside one micro-batch: a handful
        try:
            numbers = [row[batch_col] for row in kept.select(batch_col).distinct().orderBy(batch_col).collect()]
            if before is not None and numbers:
                before(micro.sparkSession, numbers[0])
            for number in numbers:
                handle(kept.filter(F.col(batch_col) == number).drop(batch_col), number, epoch)
        finally:
            kept.unpersist()

    return run


class _Learn:
    """One step of predict-then-learn: scores of new rows from a model of the window, and labelled rows into the window."""

    def __init__(self, root, estimator, numeric, cat, mv, label, key, size, max_null, on_score):
        self.window, self.cleaner = BatchWindow(root, size), FitOnceCleaner(root, max_null)
        self.root, self.estimator, self.on_score = root, estimator, on_score
        self.numeric, self.cat, self.mv, self.label, self.key = list(numeric), list(cat), list(mv), label, key

    def clean(self, rows: DataFrame) -> DataFrame:
        return self.cleaner.transform(rows, [*self.numeric, *self.cat, *self.mv], [self.key, self.label])

    def predict(self, clean: DataFrame, number: int, micro: int, earlier: DataFrame | None) -> None:
        """Scores the rows of a batch; ``earlier`` are rows of the same batch that came before and only count."""
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.functions import vector_to_array

        past = self.window.read(clean.sparkSession, number)
        if past is None or not past.head(1):
            return
        cats, mvs, nums = ([c for c in names if c in clean.columns] for names in (self.cat, self.mv, self.numeric))
        known = clean.withColumn("_now", F.lit(True))
        if earlier is not None:
            known = known.unionByName(earlier.withColumn("_now", F.lit(False)))
        train, test = encode_window(past, known, cats, mvs, key=self.key)
        vector = VectorAssembler(inputCols=[*nums, *[f"{c}_count" for c in cats], *[f"{c}_mv" for c in mvs]], outputCol="features")
        rows = vector.transform(train).select("features", F.col(self.label).cast("double").alias("label"))
        if rows.select("label").distinct().limit(2).count() < 2:
            return
        scored = self.estimator.fit(rows).transform(vector.transform(test.filter("_now")))
        scores = scored.select(self.key, vector_to_array("probability")[1].alias("score"), F.lit(number).alias("batch_no"))
        _append(scores, f"{self.root}/scores", number, micro)
        if self.on_score is not None:
            self.on_score(scores, number)


def prequential(
    stream: DataFrame,
    root: str,
    estimator,
    numeric: Sequence[str],
    cat: Sequence[str],
    mv: Sequence[str] = (),
    label: str = "y",
    key: str = "id",
    size: int = WINDOW,
    max_null: float = 0.9,
    on_score: Callable[[DataFrame, int], None] | None = None,
):
    """Starts a query that, per batch, predicts with a model from the window, then adds the labelled batch to it.

    For labels that ride in the stream. Scores go to ``<root>/scores`` by batch
    number. A batch that arrives in several micro-batches is predicted part by
    part, always from the batches before it; counts of categories cover the
    window and what has arrived of the batch.
    """
    step = _Learn(root, estimator, numeric, cat, mv, label, key, size, max_null, on_score)

    def handle(batch: DataFrame, number: int, micro: int) -> None:
        clean = step.clean(batch)
        step.predict(clean, number, micro, step.window.earlier_parts(batch.sparkSession, number, micro))
        step.window.push(clean, number, micro)

    return (
        stream.writeStream.foreachBatch(each_batch(handle, before=step.window.expire))
        .option("checkpointLocation", f"{root}/progress")
        .trigger(availableNow=True)
        .start()
    )


# name of the event-time column of the two streams
ARRIVED = "arrived"

_STATE = "spark.sql.streaming.stateStore"
# Rows that wait for their label are state of the join. The default store keeps all of it on the heap of the executors, so its
# size would be bounded by their memory; this one keeps it on disk, with a bounded cache for all partitions of an executor.
STATE_ON_DISK = {
    f"{_STATE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_STATE}.rocksdb.boundedMemoryUsage": "true",
    f"{_STATE}.rocksdb.maxMemoryUsageMB": "256",
    f"{_STATE}.rocksdb.changelogCheckpointing.enabled": "true",
    f"{_STATE}.rocksdb.trackTotalNumberOfRows": "false",
}


def _started_with(spark: SparkSession, settings: dict[str, str], start: Callable):
    """Starts a query with settings that the session has not chosen itself; a query copies them, the session stays as it is."""
    added = {name: value for name, value in settings.items() if name not in spark.conf.getAll}
    try:
        for name, value in added.items():
            spark.conf.set(name, value)
        return start()
    finally:
        for name in added:
            spark.conf.unset(name)


def prequential_late(
    features: DataFrame,
    labels: DataFrame,
    root: str,
    estimator,
    numeric: Sequence[str],
    cat: Sequence[str],
    mv: Sequence[str] = (),
    label: str = "y",
    key: str = "id",
    size: int = WINDOW,
    max_null: float = 0.9,
    bound: str = "30 days",
    on_score: Callable[[DataFrame, int], None] | None = None,
    trigger: dict | None = None,
):
    """Starts a query over two streams: rows to predict, and their labels, which come later.

    ``features`` has the key, ``batch_no``, the inputs and ``arrived``;
    ``labels`` has the key, the label and ``arrived``. A stream-stream join
    keeps a row in the state store until its label comes, at most ``bound``
    of event time; older rows leave the state and are never learned from. The
    state is kept on the executors' disks, unless the session names a store.
    In each micro-batch the rows whose labels came join the window first, then
    the new rows are predicted from the last ``size`` labelled batches. Scores
    go to ``<root>/scores``, scores with their labels to ``<root>/judged``.
    """
    step = _Learn(root, estimator, numeric, cat, mv, label, key, size, max_null, on_score)
    seen = features.withWatermark(ARRIVED, bound)
    told = labels.select(F.col(key).alias("_key"), label, F.col(ARRIVED).alias("_told")).withWatermark("_told", bound)
    in_time = (F.col("_told") >= F.col(ARRIVED)) & (F.col("_told") <= F.col(ARRIVED) + F.expr(f"interval {bound}"))
    known = seen.join(told, (F.col(key) == F.col("_key")) & in_time).drop("_key", "_told")
    kind = features.sparkSession.createDataFrame([], labels.select(label).schema).schema[label].dataType
    fresh = features.withColumn(label, F.lit(None).cast(kind))
    both = known.select(*features.columns, label, F.lit(True).alias("_labelled")).unionByName(
        fresh.select(*features.columns, label, F.lit(False).alias("_labelled"))
    )

    def run(micro: DataFrame, epoch: int) -> None:
        spark = micro.sparkSession
        kept = micro.drop(ARRIVED).persist()
        try:
            numbers = kept.select("_labelled", "batch_no").distinct().collect()  # batches in one micro-batch: a handful
            late, now = (sorted(r["batch_no"] for r in numbers if r["_labelled"] is flag) for flag in (True, False))
            for number in now:  # the columns are chosen on the first rows that come, labelled or not
                step.clean(kept.filter((F.col("batch_no") == number) & ~F.col("_labelled")))
            for number in late:
                rows = kept.filter((F.col("batch_no") == number) & F.col("_labelled")).drop("batch_no", "_labelled")
                step.window.push(step.clean(rows), number, epoch)
                scores = _stored(spark, f"{root}/scores")
                if scores is not None:
                    own = scores.filter(F.col("batch_no") == number).select(key, "score")
                    _append(rows.select(key, label).join(own, key), f"{root}/judged", number, epoch)
            for number in now:
                rows = kept.filter((F.col("batch_no") == number) & ~F.col("_labelled")).drop("batch_no", "_labelled")
                step.predict(step.clean(rows), number, epoch, None)
            if late:
                step.window.expire(spark, late[0])
        finally:
            kept.unpersist()

    writer = (
        both.writeStream.foreachBatch(run)
        .option("checkpointLocation", f"{root}/progress")
        .trigger(**(trigger or {"availableNow": True}))
    )
    return _started_with(features.sparkSession, STATE_ON_DISK, writer.start)


def batch_auc(scores: DataFrame, labels: DataFrame, key: str = "id", label: str = "y") -> DataFrame:
    """(batch_no, auc, gini) from scores and labels that arrived later, joined on the key."""
    from foldwise.plans.evaluate import auc

    return auc(scores.join(labels.select(key, label), key), label, "score", ["batch_no"])


class RunningFrequencies:
    """Counts per value kept batch by batch; the live counts are the sum over the batches of the window."""

    def __init__(self, root: str, cols: Sequence[str], size: int = WINDOW):
        self.path, self.cols, self.size = f"{root}/counts", list(cols), size

    def push(self, batch: DataFrame, batch_no: int, micro: int = 0) -> None:
        filled = batch.select(*[F.coalesce(F.col(c).cast("string"), F.lit("-1")).alias(c) for c in self.cols])
        _append(frequencies(filled, self.cols), self.path, batch_no, micro)

    def expire(self, spark: SparkSession, current: int) -> None:
        """Removes the counts of batches that no window from ``current`` on holds, so the state stays as large as a window."""
        counts = _stored(spark, self.path)
        kept = [] if counts is None else _last_batches(counts, current, self.size)
        if len(kept) == self.size:
            for folder in paths_like(spark, f"{self.path}/batch_no=*"):
                if int(folder.rpartition("=")[2]) < min(kept):
                    remove_folder(spark, folder)

    def live(self, spark: SparkSession, current: int) -> DataFrame:
        """(feature, value, cnt) over the batch ``current`` and the last ``size`` before it, whatever their numbers."""
        counts = spark.read.parquet(self.path)
        rows = counts.filter(F.col("batch_no").isin([current, *_last_batches(counts, current, self.size)]))
        return rows.groupBy("feature", "value").agg(F.sum("cnt").alias("cnt"))


def running_frequencies(stream: DataFrame, root: str, cols: Sequence[str], size: int = WINDOW):
    """Starts the query that keeps the per-batch counts; returns (query, state)."""
    state = RunningFrequencies(root, cols, size)
    query = (
        stream.writeStream.foreachBatch(each_batch(state.push, before=state.expire))
        .option("checkpointLocation", f"{root}/progress-counts")
        .trigger(availableNow=True)
        .start()
    )
    return query, state


def windowed_frequencies(df: DataFrame, cols: Sequence[str], size: int = WINDOW, batch_col: str = "batch_no") -> DataFrame:
    """(batch_no, feature, value, cnt) for every batch at once: each batch with the ``size`` before it, whatever their numbers.

    A value counted in a batch adds to that batch and the following ``size``
    ones; the table has one row per value and batch, whatever the row counts.
    """
    filled = df.select(batch_col, *[F.coalesce(F.col(c).cast("string"), F.lit("-1")).alias(c) for c in cols])
    counts = frequencies(filled, cols, [batch_col])
    order = Window.orderBy(batch_col)  # one row for each batch
    reached = F.array_compact(F.array(F.col(batch_col), *[F.lead(batch_col, k).over(order) for k in range(1, size + 1)]))
    following = df.select(batch_col).distinct().select(batch_col, reached.alias("_reached"))
    spread = counts.join(following, batch_col).withColumn(batch_col, F.explode("_reached"))
    return spread.groupBy(batch_col, "feature", "value").agg(F.sum("cnt").alias("cnt"))
