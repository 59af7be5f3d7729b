"""Predictions of a run meet once, and a run leaves nothing but its saved parts."""

import os

import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from foldwise.plans import stacking as S
from foldwise.session import checkpoint_dir


def test_forms_of_an_aggregate_meet_once(spark):
    values = [("train" if i % 40 < 30 else "test", i % 40, float(i * i % 17)) for i in range(200)] + [("train", 7, None)]
    p = spark.createDataFrame(values, "part string, id int, value double")
    forms = {"a": ("mean", "agg_first"), "b": ("mean", "inverse_first"), "c": ("median", "inverse_first")}
    back = lambda c: F.exp(c) - 1
    done = S.aggregate_predictions(p, "id", forms, back)
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    got = {r["id"]: r for r in done.collect()}
    for name, (agg, order) in forms.items():
        for r in S.aggregate_predictions(p, "id", agg, back, order).collect():
            assert got[r["id"]][name] == pytest.approx(r["value"])


def test_a_run_keeps_its_parts_only_and_scores_every_row(spark, tmp_path):
    # ids come twice, with targets of their own
    rows = [(i % 60, float(i % 13), float(i % 13) * 2 + i % 5) for i in range(90)]
    train = spark.createDataFrame(rows, "id int, x double, y double")
    test = spark.createDataFrame([(100 + i, float(i)) for i in range(20)], "id int, x double")
    preset = S.Preset("line", ("x",), LinearRegression(solver="normal", regParam=0.1), target="y", agg="median")
    folder = checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    run, scores = S.train_run(train, test, preset, str(tmp_path), "20240101-0000", k=3, n_splits=2, n_bags=2)
    assert set(os.listdir(folder)) == before
    saved = {p: spark.read.parquet(f"{tmp_path}/predictions/run={run}/part={p}") for p in ("train", "test-foldavg", "test-fulltrain")}
    assert {p: d.count() for p, d in saved.items()} == {"train": 60, "test-foldavg": 20, "test-fulltrain": 20}
    error = F.avg(F.abs(F.col("value") - F.col("y")))
    assert scores["mae"] == pytest.approx(train.join(saved["train"], "id").agg(error).first()[0])
    raw = S.oof_predict(train, test, preset, 3, 2, 2)
    own = S.aggregate_predictions(raw.filter("part = 'train'"), "id", "median", by=("split", "fold"))
    folds = [r["m"] for r in own.join(train, "id").groupBy("split", "fold").agg(error.alias("m")).collect()]
    mean = sum(folds) / len(folds)
    assert scores["mae_mean"] == pytest.approx(mean)
    assert scores["mae_std"] == pytest.approx((sum((m - mean) ** 2 for m in folds) / len(folds)) ** 0.5)
