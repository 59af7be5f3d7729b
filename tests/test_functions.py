"""Scalar functions and cleaning on hand-made rows."""

import json
from statistics import NormalDist

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from foldwise.encoders import blocks
from foldwise.functions import geo, numeric, plans_json
from foldwise.operators import clean as P, joins as J
from foldwise.sources import parts, predictions, tables


def plan(d, p, e, m):
    return {"distance": d, "price": p, "eta": e, "transport_mode": m}


def test_plan_block_on_hand_rows(spark):
    rows = [
        ("null", None),
        ("bad", "bad"),
        ("object", '{"distance": 1}'),
        ("empty", "[]"),
        ("one", json.dumps([plan(100, "", 60, 3)])),
        ("ties", json.dumps([plan(5, 10, 9, 1), plan(9, 30, 9, 2), plan(9, 30, 1, 7), plan(5, 10, 1, 11)])),
        ("same", json.dumps([plan(1, 2, 3, 4), plan(3, 2, 1, 4)])),
    ]
    done = {r["sid"]: r for r in blocks.plan_features(spark.createDataFrame(rows, "sid string, plans string"), "plans").collect()}
    for sid in ("null", "bad", "object", "empty"):
        r = done[sid]
        assert r["num_max_dist"] == r["num_std_eta"] == r["num_min_price_mode"] == -1
        assert r["cat_mode_feas_0"] == 1 and r["cat_first_mode"] == 0 and r["mode_text"] == "word_null"
    one = done["one"]
    assert one["num_max_price"] == 0 and one["num_std_dist"] == 0 and one["cat_mode_feas_3"] == 1 and one["cat_mode_feas_0"] == 0
    ties = done["ties"]
    assert (ties["num_min_dist_mode"], ties["num_max_dist_mode"]) == (1, 7)
    assert (ties["num_min_eta_mode"], ties["num_max_eta_mode"]) == (7, 2)
    assert ties["num_mean_dist"] == 7 and ties["num_std_dist"] == pytest.approx(2)
    assert ties["mode_text"] == "word_1 word_2 word_7 word_11"
    assert done["same"]["num_max_dist_mode"] == 4
    first = blocks.plan_features(spark.createDataFrame(rows, "sid string, plans string"), "plans", ties="first")
    assert first.filter("sid = 'ties'").first()["num_max_dist_mode"] == 2


def test_numbers_that_are_none(spark):
    rows = [("a", json.dumps([plan("12.7", "x", None, 3), plan(8, 5, 2, 4)])), ("b", '[{"distance": 4}]')]
    df = spark.createDataFrame(rows, "sid string, plans string")
    got = plans_json.explode_plans(df, "plans", ["sid"]).orderBy("sid", "pos").collect()
    assert [tuple(r)[2:] for r in got] == [(12, None, None, 3), (8, 5, 2, 4), (4, None, None, None)]
    done = {r["sid"]: r for r in blocks.plan_features(df, "plans").collect()}
    assert done["a"]["num_max_price_mode"] == 4 and done["a"]["num_max_dist_mode"] == 3
    pair = spark.createDataFrame([("1.5,2",), ("bad",), (None,)], "t string").select(*geo.split_pair(F.col("t")))
    assert [tuple(r) for r in pair.collect()] == [(1.5, 2.0), (None, None), (None, None)]


def test_explode_keeps_or_drops_empty_lists(spark):
    rows = [("a", json.dumps([plan(1, "", 2, 3)])), ("b", "[]")]
    df = spark.createDataFrame(rows, "sid string, plans string")
    assert plans_json.explode_plans(df, "plans", ["sid"]).collect() == [("a", 1, 1, None, 2, 3)]
    assert plans_json.explode_plans(df, "plans", ["sid"], outer=True).count() == 2


def test_geodesic_against_published_lines():
    # Flinders Peak to Buninyong, 54 972.271 m
    lat1, lng1 = -(37 + 57 / 60 + 3.72030 / 3600), 144 + 25 / 60 + 29.52440 / 3600
    lat2, lng2 = -(37 + 39 / 60 + 10.15610 / 3600), 143 + 55 / 60 + 35.38390 / 3600
    # that line is given on another ellipsoid whose length differs by a few centimetres
    assert geo.ellipsoid_metres([lat1], [lng1], [lat2], [lng2])[0] == pytest.approx(54972.271, abs=0.1)
    got = geo.ellipsoid_metres([0, 10, 0], [0, 20, 0], [0, 10, 0.5], [1, 20, 179.7])
    assert got[0] == pytest.approx(111319.490793, abs=1e-3)
    assert got[1] == 0
    assert 19.9e6 < got[2] < 20.1e6
    assert np.isnan(geo.ellipsoid_metres([np.nan], [0], [0], [0])[0])


def test_erfinv(spark):
    xs = [-0.999, -0.9, -0.5, -1e-9, 0.0, 0.1, 0.42, 0.8, 0.999, 0.9999999]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", numeric.erfinv(F.col("x")).alias("y"))
    for r in df.collect():
        assert r["y"] == pytest.approx(NormalDist().inv_cdf((r["x"] + 1) / 2) / 2**0.5, rel=1e-9, abs=1e-12)


def test_alpha_code(spark):
    df = spark.createDataFrame([("A",), ("Z",), ("AA",), ("CAT",)], "s string")
    assert [r[0] for r in df.select(numeric.alpha_code(F.col("s"))).collect()] == [1, 26, 27, 2074]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(min_value=1.0, max_value=1e5), min_size=1, max_size=8))
def test_target_transforms_invert(spark, ys):
    df = spark.createDataFrame([(y,) for y in ys], "y double")
    for name, args in (("log", ()), ("log_ofs", (200,)), ("pow", (0.25,)), ("pow_ofs", (0.2, 5)), ("norm", ())):
        forward, inverse = numeric.target_transform(name, *args)
        for r in df.select("y", inverse(forward(F.col("y"))).alias("z")).collect():
            assert r["z"] == pytest.approx(r["y"], rel=1e-6)


def test_narrow_types(spark):
    df = spark.createDataFrame([(1, 1.0, 0.5, 300.0, None), (2, -3.0, float("nan"), 70000.0, 1.0)], "a long, b double, c double, d double, e double")
    done, filled = P.narrow_types(df)
    assert dict(done.dtypes) == {"a": "tinyint", "b": "tinyint", "c": "float", "d": "int", "e": "smallint"}
    assert filled == ["c", "e"]
    assert done.filter("a = 2").first()["c"] == -999.0


def test_edges_need_more_than_the_minimum(spark):
    df = spark.createDataFrame([(0.0, 1.0)] * 20 + [(5.0, 0.0)] * 21, "a double, b double")
    flags = P.EdgeFlags(["a", "b"]).fit(df)
    assert flags.feature_names() == ["b_zero"]


def test_null_is_not_equal_to_null(spark):
    df = spark.createDataFrame([(None, None), ("x", "x"), ("x", None)], "a string, b string")
    assert [r["s"] for r in P.equal_flags(df, {"s": ("a", "b")}).collect()] == [0, 1, 0]


def test_drop_sparse_reuses_first_choice(spark):
    first = spark.createDataFrame([(1, None, 1.0)] * 9 + [(1, 2, float("nan"))], "a int, b int, c double")
    later = spark.createDataFrame([(None, 2, 3.0)], "a int, b int, c double")
    sparse = P.DropSparse(0.9).fit(first)
    assert sparse.columns == ["a", "c"]
    assert sparse.transform(later).columns == ["a", "c"]


def test_left_dim_gives_null_key_the_sentinel_row(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 9)], "sid int, pid int")
    dim = spark.createDataFrame([(5, 1.5)], "pid int, p0 double")
    assert sorted(J.left_dim(df, dim, "pid").select("sid", "p0").collect()) == [(1, 1.5), (2, 0.0), (3, None)]


def test_parts_replace_only_their_split(spark, tmp_path):
    root = str(tmp_path)
    df = spark.createDataFrame([(1, "train", 1.0), (2, "test", 2.0)], "id int, split string, x double")
    parts.save_part(df, root, "numeric")
    parts.save_part(df.filter("split = 'test'").withColumn("x", F.lit(7.0)), root, "numeric")
    assert parts.load_part(spark, root, "numeric", "train").collect() == [(1, 1.0)]
    assert parts.load_part(spark, root, "numeric", "test").collect() == [(2, 7.0)]
    assert parts.part_features(spark, root, "numeric") == ["x"]


def test_predictions_prefer_the_named_test_part(spark, tmp_path):
    root = str(tmp_path)
    one = lambda v: spark.createDataFrame([(1, v)], "id int, value double")
    predictions.save_predictions(one(2.0), root, "a", "test")
    predictions.save_predictions(one(4.0), root, "a", "test-foldavg")
    load = lambda mode: predictions.load_prediction(spark, root, "a", "test", mode).first()["value"]
    assert (load("foldavg"), load("fulltrain")) == (4.0, 2.0)
    twice = predictions.load_prediction(spark, root, ["a", ("a", {"power": 2})], "test", "foldavg")
    assert twice.first()["value"] == 10.0


def test_csv_keeps_json_text(spark, tmp_path):
    text = json.dumps([plan(1, "", 2, 3)])
    df = spark.createDataFrame([(1, text)], "sid int, plans string")
    tables.write_csv(df, str(tmp_path / "p"))
    assert tables.read_csv(spark, str(tmp_path / "p"), "sid int, plans string").collect() == [(1, text)]


def test_roles(spark):
    df = spark.createDataFrame([(1, "a", 2.0, 3.0, 4.0, 5.0)], "id int, cat_x string, num_y double, cont1 double, svd0 double, loss double")
    assert tables.roles(df) == {"cat": ["cat_x"], "num": ["num_y", "cont1"], "svd": ["svd0"]}
