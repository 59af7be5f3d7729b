"""Learning, stacking, scores and streams: invariants and brute force."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from foldwise.encoders.categorical import TargetMean
from foldwise.operators.rows import kfold
from foldwise.plans import evaluate as E, learners as L, stacking as S
from foldwise.streaming import batches as T


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(2)
    data = [(i, float(rnd.randrange(1, 50)), rnd.uniform(1, 3), rnd.choice("AB"), 0.0) for i in range(300)]
    data = [(i, a, b, c, 10 * a + 50 * b + 20 * (c == "A") + rnd.gauss(0, 5) + 100) for i, a, b, c, _ in data]
    return spark.createDataFrame(data, "id int, a double, b double, c string, loss double").cache()


def test_median_regression_one_column(rows):
    got = L.MedianRegression().fit(rows, ["a"], "loss").coefficients[0]
    frame = rows.toPandas()
    errors = {r: (frame["loss"] - r * frame["a"]).abs().sum() for r in frame["loss"] / frame["a"]}
    assert (frame["loss"] - got * frame["a"]).abs().sum() == pytest.approx(min(errors.values()))


def test_median_regression_two_columns(rows):
    fit = L.MedianRegression(max_iter=60).fit(rows, ["a", "b"], "loss")
    frame = rows.toPandas()

    def error(w):
        return np.abs(frame["loss"] - frame[["a", "b"]].to_numpy() @ w).mean()

    best = error(np.array(fit.coefficients))
    for step in (0.05, -0.05):
        assert error(np.array(fit.coefficients) + [step, 0]) >= best - 1e-3
        assert error(np.array(fit.coefficients) + [0, step * 10]) >= best - 1e-3


def test_ridge_closed_form(rows):
    from pyspark.ml.feature import VectorAssembler

    vectors = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows).withColumn("label", F.col("loss"))
    model = L.ridge(50.0).fit(vectors)
    frame = rows.toPandas()
    x = frame[["a", "b"]].to_numpy()
    x, y = x - x.mean(axis=0), frame["loss"].to_numpy() - frame["loss"].mean()
    want = np.linalg.solve(x.T @ x + 50 * np.eye(2), x.T @ y)
    assert np.allclose(model.coefficients.toArray(), want)


def test_out_of_fold_rows_are_predicted_once_and_not_leaked(rows):
    preset = S.Preset("p", ("a", "b"), LinearRegression(solver="normal"), encoders=(TargetMean(["c"], "loss", noisy=False),))
    found = S.oof_predict(rows, rows.limit(20), preset, k=3)
    sizes = dict(found.groupBy("part").count().collect())
    assert sizes == {"train": 300, "test-foldavg": 60, "test-fulltrain": 20}
    assert found.filter("part = 'train'").select("id").distinct().count() == 300
    # a row whose own target is changed keeps its out-of-fold prediction
    before = found.filter("part = 'train' and id = 7").first()["value"]
    changed = rows.withColumn("loss", F.when(F.col("id") == 7, 1e6).otherwise(F.col("loss")))
    after = S.oof_predict(changed, None, preset, k=3, full=False).filter("id = 7").first()["value"]
    assert after == pytest.approx(before)
    scored = found.filter("part = 'train'").join(rows, "id")
    constant = rows.agg(F.percentile("loss", F.lit(0.5))).first()[0]
    flat = rows.agg(F.avg(F.abs(F.col("loss") - constant))).first()[0]
    assert E.mae(scored, "loss", "value").first()["mae"] < flat / 2


def test_more_folds_than_rows(spark):
    df = spark.createDataFrame([(1,), (2,)], "id int")
    assert kfold(df, "id", 10).count() == 2


def test_bag_prepares_any_table_alike(rows):
    made = S.bag(rows, ["a", "b"], "id", 0.5, 0.5, None, 3)
    assert made.train.count() == 150 and len(made.columns) == 1
    assert made.prepare(rows).select("features").first()[0].size == 1
    svd = S.bag(rows, ["a", "b"], "id", None, None, 1, 3)
    assert svd.prepare(rows).select("features").first()[0].size == 1


def test_median_over_bags(spark):
    p = spark.createDataFrame([("train", 1, v) for v in (1.0, 2.0, 9.0)], "part string, id int, value double")
    assert S.aggregate_predictions(p, agg="median").first()["value"] == 2.0
    assert S.aggregate_predictions(p, inverse=lambda c: c * c, order="agg_first").first()["value"] == 16.0


def test_scores_on_hand_rows(spark):
    df = spark.createDataFrame([(0, 0, 0.1), (0, 1, 0.4), (1, 1, 0.4), (1, 1, 0.8), (2, 1, 0.3)], "y int, p int, s double")
    # class 0: 2/3, class 1: 2*2/(2+4), class 2: 0
    assert E.weighted_f1(df, "y", "p").first()[0] == pytest.approx((2 * 2 / 3 + 2 * 2 / 3) / 5)
    binary = df.filter("y < 2")
    assert E.auc(binary, "y", "s").first()["auc"] == pytest.approx((1 + 1 + 1 + 0.5) / 4)
    assert E.auc(binary.filter("y = 1"), "y", "s").first()["auc"] is None


def test_override(spark):
    df = spark.createDataFrame([(1, 0.2, 0.3, 0.25), (2, 0.1, 0.8, 0.1), (3, 0.5, 0.1, 0.1)], "id int, c0 double, c1 double, c2 double")
    got = S.override_low_confidence(df, ["c0", "c1", "c2"]).orderBy("id").select("click_mode", "changed").collect()
    assert got == [(0, 1), (1, 0), (0, 0)]


def batch(spark, number, n=6):
    return spark.createDataFrame([(number * 100 + i, "ab"[i % 2], f"{i % 3},{number}", i % 2) for i in range(n)], "id int, c string, m string, y int")


def test_window_keeps_the_last_batches_and_repeats_safely(spark, tmp_path):
    window = T.BatchWindow(str(tmp_path), 3)
    assert window.read(spark, 0) is None
    for number in range(5):
        window.push(batch(spark, number), number)
        window.push(batch(spark, number), number)
    got = dict(window.read(spark, 5).groupBy("batch_no").count().collect())
    assert got == {2: 6, 3: 6, 4: 6}
    assert window.read(spark, 1).count() == 6


def test_running_counts_equal_the_batch_job(spark, tmp_path):
    state = T.RunningFrequencies(str(tmp_path), ["c", "m"], 2)
    everything = None
    for number in range(4):
        rows = batch(spark, number, 5 + number)
        state.push(rows, number)
        tagged = rows.withColumn("batch_no", F.lit(number))
        everything = tagged if everything is None else everything.unionByName(tagged)
    for current in range(4):
        live = sorted(state.live(spark, current).collect())
        whole = T.windowed_frequencies(everything, ["c", "m"], 2)
        assert live == sorted(whole.filter(F.col("batch_no") == current).select("feature", "value", "cnt").collect())


def test_first_batch_has_no_window(spark):
    window, done = T.encode_window(None, batch(spark, 0), ["c"], ["m"])
    assert window is None
    assert [r["c_count"] for r in done.collect()] == [3] * 6


def test_cleaner_keeps_its_choice(spark, tmp_path):
    cleaner = T.fit_once_cleaner(str(tmp_path), 0.9)
    first = spark.createDataFrame([(i, 1.0, None) for i in range(20)], "id int, a double, b double")
    later = spark.createDataFrame([(1, None, 5.0)], "id int, a double, b double")
    assert cleaner.transform(first, ["a", "b"], ["id"]).columns == ["id", "a"]
    assert cleaner.transform(later, ["a", "b"], ["id"]).collect() == [(1, 0.0)]


def test_window_counts_batches_not_numbers(spark, tmp_path):
    from foldwise.streaming import batches as B

    window = B.BatchWindow(str(tmp_path), 3)
    for n in (0, 1, 2, 3):
        window.push(spark.createDataFrame([(n,)], "x int"), n)
    assert sorted(r["x"] for r in window.read(spark, 7).collect()) == [1, 2, 3]


def test_cleaner_fills_nan(spark, tmp_path):
    from foldwise.streaming import batches as B

    df = spark.createDataFrame([(1, float("nan")), (2, None), (3, 1.5)], "id int, a double")
    rows = B.fit_once_cleaner(str(tmp_path), 0.9).transform(df, ["a"], ["id"]).collect()
    assert {r["id"]: r["a"] for r in rows} == {1: 0.0, 2: 0.0, 3: 1.5}


def test_a_batch_may_arrive_in_pieces(spark, tmp_path):
    window, counts = T.BatchWindow(str(tmp_path), 2), T.RunningFrequencies(str(tmp_path), ["c"], 2)
    for number in (1, 2, 5):  # a number is missing
        rows = batch(spark, number)
        for micro in (0, 1, 1):  # the second piece comes twice
            piece = rows.filter(F.col("id") % 2 == micro)
            window.push(piece, number, micro)
            counts.push(piece, number, micro)
    assert dict(window.read(spark, 6).groupBy("batch_no").count().collect()) == {2: 6, 5: 6}
    assert window.earlier_parts(spark, 5, 1).count() == 3
    live = {r["value"]: r["cnt"] for r in counts.live(spark, 5).collect()}
    assert live == {"a": 9, "b": 9}
    window.expire(spark, 6)
    window.expire(spark, 6)
    assert sorted(r["batch_no"] for r in spark.read.parquet(window.path).select("batch_no").distinct().collect()) == [2, 5]


def test_windowed_counts_follow_batches_not_numbers(spark):
    rows = [(n, "a") for n in (1, 4, 9)]
    got = T.windowed_frequencies(spark.createDataFrame(rows, "batch_no int, c string"), ["c"], 1).collect()
    assert {r["batch_no"]: r["cnt"] for r in got} == {1: 1, 4: 2, 9: 2}


def test_late_labels_and_expired_state(spark, tmp_path):
    """A label that comes in time is judged once; one beyond the bound is not; old state goes."""
    from pyspark.ml.classification import NaiveBayes

    from foldwise.streaming import batches as T

    rng = random.Random(4)
    data = [(100 * b + k, b, rng.random() * 5, rng.choice("abc"), int(rng.random() < 0.4)) for b in range(5) for k in range(100)]
    for b in range(5):
        at = dt.datetime(2024, 1, 1 + b)
        rows = [(i, b, x, c, at) for i, n, x, c, _ in data if n == b]
        # labels of the batch before; those of ids that end in 7 come days late
        late = [(i, y, at) for i, n, _, _, y in data if n == b - 1 and i % 10 != 7] + [(i, y, at) for i, n, _, _, y in data if n == b - 4 and i % 10 == 7]
        spark.createDataFrame(rows, "id long, batch_no int, num double, cat string, arrived timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/rows")
        spark.createDataFrame(late, "id long, y int, arrived timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/labels")
    streams = [
        spark.readStream.schema(spark.read.parquet(f"{tmp_path}/{n}").schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{n}")
        for n in ("rows", "labels")
    ]
    root = f"{tmp_path}/state"
    T.prequential_late(*streams, root, NaiveBayes(), ["num"], ["cat"], bound="2 days").awaitTermination()
    judged = {r["id"]: r["y"] for r in spark.read.parquet(f"{root}/judged").collect()}
    assert judged == {i: y for i, n, _, _, y in data if n in (1, 2, 3) and i % 10 != 7}
    assert {r["batch_no"] for r in spark.read.parquet(f"{root}/scores").select("batch_no").distinct().collect()} == {1, 2, 3, 4}
    assert spark.read.parquet(f"{root}/window").filter("id % 10 = 7").count() == 0


def test_counts_stay_bounded(spark, tmp_path):
    from foldwise.streaming import batches as T

    state = T.RunningFrequencies(str(tmp_path), ["c"])
    for b in range(12):
        state.expire(spark, b)
        state.push(spark.createDataFrame([(f"v{b}",), ("all",)], "c string"), b)
        assert len(list((tmp_path / "counts").glob("batch_no=*"))) <= T.WINDOW + 1
    live = {r["value"]: r["cnt"] for r in state.live(spark, 11).collect()}
    assert live == {"all": 4, "v8": 1, "v9": 1, "v10": 1, "v11": 1}


def test_presets_in_order(spark, tmp_path):
    from pyspark.ml.regression import LinearRegression

    line = LinearRegression(solver="normal")
    a = S.Preset("a", ("x",), line, predictions=("b",))
    b = S.Preset("b", ("x",), line, predictions=(["a"],))
    rows = spark.createDataFrame([(i, float(i), 2.0 * i) for i in range(20)], "id long, x double, loss double")
    with pytest.raises(ValueError, match="a -> b -> a"):
        S.run_presets(rows, rows, {"a": a, "b": b}, ["a"], str(tmp_path), "20240101-0000")
    assert S.prediction_names(("a", ["a", "b"], ("b", {"power": 1.5}), ["b"])) == ["a", "pred_1", "b^1_5", "pred_2"]
    from foldwise.sources.predictions import find_run, save_predictions

    for run in ("20240101-0000-a-1.00000", "20240102-0000-a-2.00000", "20240103-0000-a-b-1.00000"):
        save_predictions(rows.select("id", "x"), str(tmp_path), run, "train")
    assert find_run(spark, str(tmp_path), "a") == "20240102-0000-a-2.00000"
    with pytest.raises(LookupError):
        find_run(spark, str(tmp_path), "c")


def test_approximate_neighbours(spark):
    from foldwise.operators.knn import knn_join
    from foldwise.operators.knn_lsh import lsh_knn_join

    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec")
    )
    some = rows.filter("id % 20 = 0")
    pairs = lambda df: {(r["id"], r["base_id"]): round(r["dist"], 9) for r in df.collect()}
    exact = pairs(knn_join(some, rows, "id", "vec", 5, others=True))
    found = pairs(lsh_knn_join(some, rows, "id", "vec", 5, bucket_rows=20, others=True))
    common = exact.keys() & found.keys()
    assert len(common) >= 0.9 * len(exact) and all(exact[p] == found[p] for p in common)
    assert not any(a == b for a, b in found)
    assert knn_join(some, rows.limit(0), "id", "vec", 5).count() == lsh_knn_join(some, rows.limit(0), "id", "vec", 5).count() == 0
    same = rows.limit(3).crossJoin(spark.range(40)).select(F.monotonically_increasing_id().alias("id"), "vec")
    assert lsh_knn_join(same, same, "id", "vec", 4, bucket_rows=5).count() == 480


def test_boosting_prefixes_and_missing_values(spark):
    """Scores after n rounds are those of a fit with n rounds, and a class ensemble is better than the constant."""
    from foldwise.plans.boosting import Boosting

    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] > 0).astype(int) + (x[:, 1] > 0.5)
    x[::17, 2] = np.nan
    from pyspark.ml.linalg import Vectors

    rows = [(i, Vectors.dense(v), float(c)) for i, (v, c) in enumerate(zip(x.tolist(), y))]
    df = spark.createDataFrame(rows, ["id", "features", "label"])
    long = Boosting("softmax", 3, rounds=10, depth=2, rate=0.3).fit(df)
    short = Boosting("softmax", 3, rounds=4, depth=2, rate=0.3).fit(df)
    staged = {r["id"]: r["margins"] for r in long.staged(df, 2).filter("round = 4").collect()}
    direct = {r["id"]: r["margins"] for r in short.transform(df).collect()}
    assert all(np.allclose(staged[i], direct[i]) for i in direct)
    hits = long.transform(df).filter("prediction = label").count()
    assert hits > 360


def test_joint_factorisation_machine(spark):
    """The gradient is right, and small where the fit stops."""
    from pyspark.ml.linalg import Vectors

    from foldwise.plans.factorisation import SoftmaxFM, loss_and_gradient

    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4))
    y = np.where(x[:, 0] * x[:, 1] > 0, 0, np.where(x[:, 2] > 0, 1, 2))  # a product of two inputs, then a third
    theta, w = rng.normal(0, 0.3, 3 * (1 + 4 + 8)), rng.uniform(1, 2, 300)
    value, grad = loss_and_gradient(x, y, w, theta, 3, 2)
    for k in range(0, len(theta), 5):
        step = np.zeros(len(theta))
        step[k] = 1e-6
        up, down = (loss_and_gradient(x, y, w, theta + s * step, 3, 2)[0] for s in (1, -1))
        assert abs((up - down) / 2e-6 - grad[k]) < 1e-3 * max(1, abs(grad[k]))
    df = spark.createDataFrame([(Vectors.dense(v), float(c)) for v, c in zip(x.tolist(), y)], ["features", "label"]).coalesce(2)
    model = SoftmaxFM(3, factors=2, max_iter=120, tol=1e-3, penalty=1e-2).fit(df)
    assert model.converged and model.gradient < 1e-3
    right = model.transform(df).filter("prediction = label").count()
    assert right > max(np.bincount(y)) + 60


def test_out_of_fold_reads_computed_tables(spark):
    """The folds and the test rows are computed once, not again by every model and every reader of the predictions."""
    from foldwise.operators.rows import stratified_kfold
    from foldwise.plans import stacking as S

    rows = spark.range(60).selectExpr("id", "cast(id % 7 as double) as x", "id % 2 as y")
    other = rows.withColumn("id", F.col("id") + 100).join(rows.select("x").distinct(), "x")
    preset = S.Preset("line", ("x",), LinearRegression(solver="normal"), target="y")
    found = S.oof_predict(rows, other, preset, k=2, fold_of=lambda d, s: stratified_kfold(d, "id", "y", 2, s))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan
    assert {(r["part"], r["count"]) for r in found.groupBy("part").count().collect()} == {("train", 60), ("test-foldavg", 120), ("test-fulltrain", 60)}


def test_median_of_predictions_is_the_percentile(spark):
    from foldwise.plans import stacking as S

    values = [(1, 3.0), (1, 0.1), (1, 0.2), (2, 0.1), (2, 0.7), (3, None), (4, None), (4, 5.0), (5, float("nan")), (5, 1.0), (5, 2.0), (None, 4.0), (6, float("inf")), (6, float("inf"))]
    p = spark.createDataFrame(values, "id int, value double").withColumn("part", F.lit("train"))
    got = S.aggregate_predictions(p, "id", "median").select("id", "value").collect()
    want = p.groupBy("id").agg(F.percentile("value", F.lit(0.5)).alias("value")).collect()
    assert sorted(map(str, got)) == sorted(map(str, want))
    plan = S.aggregate_predictions(p, "id", "median")._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan  # its table of counts per key


@pytest.mark.parametrize("name", ["m3_bagging", "e17_e21_session_table"])
def test_results_join_nothing_again(spark, name):
    """What is read more than once is computed first: the result is row-wise work on written tables."""
    from compare import ROOT

    from foldwise.plans.catalogue import QUERIES

    plan = QUERIES[name](spark, f"{ROOT}/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
