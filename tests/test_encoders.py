"""Encoders against brute force on hand-made rows."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from foldwise.encoders import blocks, categorical as C, numeric as N, projection as V
from foldwise.operators import knn
from foldwise.plans import stacking as S


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(11)
    data = []
    for i in range(400):
        a = rnd.choice(["A", "B", "AA", "C", None])
        b = f"v{rnd.randrange(300)}"
        data.append((i, a, b, rnd.expovariate(1.0), float(rnd.randrange(5)), 3.0, math.exp(rnd.gauss(5, 1)), i % 4))
    return spark.createDataFrame(data, "id int, a string, b string, x double, y double, z double, loss double, fold int").cache()


def test_codes_are_length_then_lexical(rows):
    model = C.OrdinalEncode(["a", "b"], key="id").fit(rows)
    got = dict(model.transform(rows).select("a", "a_code").distinct().collect())
    assert got == {"A": 0, "B": 1, "C": 2, "AA": 3, None: None}
    levels = sorted({r["b"] for r in rows.collect()}, key=lambda v: (len(v), v))
    codes = dict(model.transform(rows).select("b", "b_code").distinct().collect())
    assert codes == {v: i for i, v in enumerate(levels)} and len(levels) > 150


def test_codes_of_a_heavy_column_are_the_same(rows):
    plain = C.OrdinalEncode(["a", "b"], key="id").fit(rows)
    cut = C.OrdinalEncode(["a", "b"], key="id", min_rows=20).fit(rows)
    pick = ("id", "a_code", "b_code")
    assert sorted(plain.transform(rows).select(*pick).collect(), key=lambda r: r[0]) == sorted(
        cut.transform(rows).select(*pick).collect(), key=lambda r: r[0]
    )


@pytest.mark.parametrize("small", [True, False])
def test_both_dictionary_joins_agree(rows, small):
    model = C.FrequencyEncode(["a", "b"], null="-1", key="id").fit(rows)
    model.small = small
    got = model.transform(rows).select("id", "a_count", "b_count").toPandas().set_index("id").sort_index()
    frame = rows.toPandas().set_index("id").sort_index()
    for c in "ab":
        filled = frame[c].fillna("-1")
        assert got[f"{c}_count"].tolist() == filled.map(filled.value_counts()).tolist()


def test_unseen_value_has_no_count(rows, spark):
    new = spark.createDataFrame([(1, "new", "v1")], "id int, a string, b string")
    assert C.FrequencyEncode(["a"], key="id").fit(rows).transform(new).first()["a_count"] is None
    assert C.FrequencyEncode(["a"], unseen=0, key="id").fit(rows).transform(new).first()["a_count"] == 0


def test_one_hot_edges(spark):
    train = [("k10", "u")] * 10 + [("k9", "u")] * 9 + [("k8", "u")] * 8 + [(None, "r")]
    test = [("k9", "u"), ("only_test", "u"), ("k10", "w")]
    make = lambda rs: spark.createDataFrame([(i, *r) for i, r in enumerate(rs)], "id int, a string, b string")
    model = C.OneHotRare(["a", "b"], 10, "id").fit(make(train), make(test))
    # b has one rare training value, but none of its rare values is in test
    assert model.feature_names() == ["a_k10", "a_rare", "b_u"]
    got = {(r["id"], r["flag"]) for r in model.transform(make(test)).collect()}
    assert got == {(0, "a_rare"), (0, "b_u"), (1, "b_u"), (2, "a_k10")}
    dense = model.assemble(make(test)).select("id", vector_to_array("flags").alias("v")).orderBy("id").collect()
    assert [r["v"] for r in dense] == [[0, 1, 1], [0, 0, 1], [1, 0, 0]]


def test_target_mean_modes(rows, spark):
    frame = rows.toPandas().set_index("id").sort_index()
    t = np.log(frame["loss"] + 100)
    prior = t.mean() * 100
    encoder = C.TargetMean(["a"], "loss", noisy=False, loo=True, combinations=[["a", "b"]])
    model = encoder.fit(rows)
    got = model.transform_fitted(rows).select("id", "a_mean").toPandas().set_index("id").sort_index()["a_mean"]
    sums, counts = t.groupby(frame["a"]).transform("sum"), t.groupby(frame["a"]).transform("count")
    want = np.exp((sums + prior - t) / (counts + 100 - 1))
    known = frame["a"].notna()
    assert np.allclose(got[known], want[known])
    unseen = spark.createDataFrame([(1, "new", "v1")], "id int, a string, b string")
    assert model.transform(unseen).first()["a_mean"] == pytest.approx(math.exp(t.mean()))
    noisy = C.TargetMean(["a"], "loss", noisy=True, seed=3).fit(rows)
    one, two = (noisy.transform_fitted(rows).select("id", "a_mean").orderBy("id").collect() for _ in range(2))
    assert one == two and len({r["a_mean"] for r in one}) > 300


def test_fold_encoding_never_sees_its_own_fold(rows):
    frame = rows.toPandas().set_index("id").sort_index()
    got = S.fold_encode(rows, C.TargetMean(["a", "b"], "loss", noisy=False)).toPandas().set_index("id").sort_index()
    t = np.log(frame["loss"] + 100)
    for fold in range(4):
        inside = frame["fold"] == fold
        prior = t[~inside].mean() * 100
        for c in "ab":
            sums = t[~inside].groupby(frame.loc[~inside, c]).sum()
            counts = t[~inside].groupby(frame.loc[~inside, c]).count()
            keys = frame.loc[inside, c]
            want = np.exp((keys.map(sums).fillna(0.0) + prior) / (keys.map(counts).fillna(0.0) + 100))
            assert np.allclose(got.loc[inside, f"{c}_mean"], want)


def test_token_ranks(spark):
    texts = ["a,b", "b", "c,b", None, "d", "c"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    # b 3, c 2, then -1, a, d once each in text order
    got = [r["t_mv"] for r in C.MultiValueEncode("t").fit(df).transform(df).orderBy("id").collect()]
    assert got == [0, 0, 0, 2, 4, 1]
    capped = [r["t_mv"] for r in C.MultiValueEncode("t", 2).fit(df).transform(df).orderBy("id").collect()]
    assert capped == [0, 0, 0, 2, 2, 1]


def test_scale_and_constant_column(rows):
    model = N.Scale(["x", "z"]).fit(rows)
    got = model.transform(rows).agg(F.avg("x_scaled"), F.stddev_pop("x_scaled"), F.max("z_scaled")).first()
    assert got[0] == pytest.approx(0, abs=1e-9) and got[1] == pytest.approx(1) and got[2] == 0


def test_reference_vector(spark):
    df = spark.createDataFrame([(0.0,), (2.0,), (4.0,), (10.0,)], "x double")
    row = df.agg(F.stddev_pop("x"), F.stddev_samp("x"), F.skewness("x")).first()
    assert row[0] == pytest.approx(3.741657, abs=1e-6) and row[1] == pytest.approx(4.320494, abs=1e-6)
    assert row[2] == pytest.approx(0.687243, abs=1e-6)


def test_box_cox_finds_the_peak(rows):
    model = N.BoxCoxSkewed(["x", "z"]).fit(rows)
    assert model.params["lambdas"]["z"] is None
    x = rows.toPandas()["x"].to_numpy() + 1
    grid = np.linspace(-6, 3, 9001)

    def likelihood(lam):
        shape = np.log(x) if abs(lam) < 1e-12 else x**lam / lam
        return (lam - 1) * np.log(x).sum() - len(x) / 2 * np.log(shape.var())

    best = max(grid, key=likelihood)
    assert model.params["lambdas"]["x"] == pytest.approx(best, abs=2e-3)


@pytest.mark.parametrize("small", [True, False])
def test_rank_gauss(rows, small):
    model = N.RankGauss(["x", "y", "z"]).fit(rows)
    model.small = small
    got = model.transform(rows).select("id", "x_gauss", "y_gauss", "z_gauss").toPandas().set_index("id").sort_index()
    from statistics import NormalDist

    frame = rows.toPandas().set_index("id").sort_index()
    for c in "xy":
        r = frame[c].rank()
        u = (r - r.min()) / (r.max() - r.min()) * 1.998 - 0.999
        g = u.map(lambda v: NormalDist().inv_cdf((v + 1) / 2) / 2**0.5)
        assert np.allclose(got[f"{c}_gauss"], (g - g.mean()) / g.std(ddof=0), atol=1e-6)
    assert got["z_gauss"].nunique() == 1


def test_saved_encoder_is_the_same(rows, spark, tmp_path):
    model = C.OrdinalEncode(["a"], key="id").fit(rows)
    model.save(spark, str(tmp_path / "m"))
    again = type(model).load(spark, str(tmp_path / "m"))
    pick = lambda m: m.transform(rows).select("id", "a_code").orderBy("id").collect()
    assert pick(again) == pick(model)
    scale = N.Scale(["x"]).fit(rows)
    scale.save(spark, str(tmp_path / "s"))
    assert type(scale).load(spark, str(tmp_path / "s")).params == scale.params


def test_svd_reproduces_the_gram_matrix(rows):
    cols = ["x", "y", "z"]
    model = V.TruncatedSvd(cols, 3).fit(rows)
    m = rows.select(*cols).toPandas().to_numpy()
    scores = model.transform(rows).orderBy("id").select(*model.feature_names()).toPandas().to_numpy()
    assert np.allclose(scores @ scores.T, m @ m.T)
    assert np.allclose(model.params["singular"], np.linalg.svd(m, compute_uv=False))
    assert model.explained_ratio(rows) == pytest.approx(1.0)
    top = np.abs(model.loadings).argmax(axis=0)
    assert (model.loadings[top, range(3)] > 0).all()


def test_tfidf_by_hand(spark):
    texts = ["word_1 word_2", "word_2", "word_null"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    model = V.TfidfNgrams("t").fit(df)
    assert model.feature_names() == ["word_1", "word_1 word_2", "word_2", "word_null"]
    idf1, idf2 = math.log(4 / 2) + 1, math.log(4 / 3) + 1
    norm = math.sqrt(2 * idf1**2 + idf2**2)
    got = model.transform(df).orderBy("id").select(vector_to_array("tfidf").alias("v")).collect()
    assert got[0]["v"] == pytest.approx([idf1 / norm, idf1 / norm, idf2 / norm, 0])
    assert got[2]["v"] == pytest.approx([0, 0, 0, 1])


def test_cluster_similarity(rows):
    model = V.ClusterRbf(["x", "y"], (3,), gamma=0.5, seed=1).fit(rows)
    centres = np.array(model.params["centres"]["3"])
    m = rows.orderBy("id").select("x", "y").toPandas().to_numpy()
    want = np.exp(-0.5 * np.linalg.norm(m[:, None] - centres[None], axis=2))
    got = np.array([r[0] for r in model.transform(rows).orderBy("id").select("cluster_rbf_3").collect()])
    assert np.allclose(got, want, atol=1e-6)


@pytest.mark.parametrize("blocks", [dict(), dict(block_rows=15, chunk_rows=7, pivots=6)])
def test_knn_against_brute_force(spark, blocks):
    rnd = np.random.RandomState(0)
    points = np.vstack([rnd.normal(size=(90, 3)), np.zeros((60, 3)), rnd.normal(size=(40, 3)) + 20])
    df = spark.createDataFrame([(i, p.tolist(), float(i % 3)) for i, p in enumerate(points)], "id int, v array<double>, y double")
    query, base_rows = df.filter("id % 4 = 0"), df.filter("id % 4 <> 0")
    got = knn.knn_join(query, base_rows, "id", "v", 5, **blocks).orderBy("id", "place").collect()
    ids = [i for i in range(len(points)) if i % 4]
    for q in range(0, len(points), 4):
        d = [(float(np.linalg.norm(points[q] - points[i])), i) for i in ids]
        want = sorted((round(a, 9), i) for a, i in d)[:5]
        mine = [(round(r["dist"], 9), r["base_id"]) for r in got if r["id"] == q]
        assert mine == want
    weighted = knn.knn_predict(query, base_rows, "id", "v", "y", 5, "distance", **blocks)
    assert weighted.count() == query.count() and weighted.filter("value is null").count() == 0
    votes = knn.knn_class_votes(query, base_rows, "id", "v", "y", 5, 3, **blocks).first()
    assert votes["c0"] + votes["c1"] + votes["c2"] == pytest.approx(1)


@pytest.mark.parametrize("kind", ["plain", "ties", "far", "nan"])
def test_nearest_in_a_block_is_exact(kind):
    rnd = np.random.RandomState(3)
    a, b = rnd.normal(size=(30, 6)), rnd.normal(size=(5000, 6))
    if kind == "ties":
        a, b = rnd.randint(0, 3, a.shape).astype(float), rnd.randint(0, 3, b.shape).astype(float)
    elif kind == "far":
        a, b = a + 1e6, b + 1e6
    elif kind == "nan":
        b[7, 2] = np.nan
    d = knn._distances(a, b)
    order = np.argsort(d, axis=1, kind="stable")[:, :9]
    r, c, dist = knn._nearest(a, b, 9)
    assert (r == np.repeat(np.arange(30), 9)).all() and (c == order.ravel()).all()
    assert np.array_equal(dist, np.take_along_axis(d, order, axis=1).ravel())


def test_small_cells_share_a_pack():
    rnd = np.random.RandomState(4)
    pivots, counts = rnd.normal(size=(64, 3)), rnd.randint(0, 40, 64)
    counts[9] = 500
    packs = knn._packs(pivots, counts, 100)
    sizes = np.bincount(packs, weights=counts)
    assert len(sizes) <= 2 * counts.sum() / 100 + 1 and sizes[sizes > 100].tolist() == [500]


def test_a_query_reaches_a_block_once(spark, monkeypatch):
    rnd = np.random.RandomState(5)
    df = spark.createDataFrame([(i, rnd.normal(size=64).tolist()) for i in range(900)], "id int, v array<double>")
    seen = []
    monkeypatch.setattr(knn, "_packs", lambda *a, made=knn._packs: seen.append(made(*a)) or seen[-1])
    got = knn.knn_join(df.filter("id % 5 = 0"), df, "id", "v", 3, others=True)
    assert seen[0].max() == 0 and got.count() == 540


def test_more_than_a_byte_of_levels(spark):
    df = spark.range(1000).select(F.col("id"), F.concat(F.lit("k"), F.col("id").cast("string")).alias("a"))
    codes = C.OrdinalEncode(["a"], key="id").fit(df).transform(df)
    assert codes.agg(F.max("a_code"), F.countDistinct("a_code")).first() == (999, 1000)


@pytest.mark.parametrize("small", [True, False])
def test_null_and_repeated_ids_keep_their_own_values(spark, small):
    rows = [(None, "x", 1.0), (None, "y", 2.0), (7, "x", 3.0), (7, "z", 2.0), (8, None, None)]
    df = spark.createDataFrame(rows, "id int, a string, v double")
    model = C.FrequencyEncode(["a"], unseen=0).fit(df)
    model.small = small
    got = [(r["id"], r["a"], r["a_count"]) for r in model.transform(df).collect()]
    assert sorted(got, key=str) == sorted([(None, "x", 2), (None, "y", 1), (7, "x", 2), (7, "z", 1), (8, None, 0)], key=str)


def test_repeated_sessions_meet_each_other_in_the_session_table(spark):
    base = spark.range(12).selectExpr("id as sid", "id % 3 as pid", "timestamp_ntz'2024-01-01' + make_dt_interval(0, int(id)) as req_time", "timestamp_ntz'2024-01-02' as plan_time", "'1.00,2.00' as o", "'2.00,1.00' as d")
    text = F.format_string('[{"distance":"%d","price":"5","eta":"3","transport_mode":"%d"}]', F.col("sid"), F.col("sid") % 4 + 1)
    plans = base.select("sid", text.alias("plans"))
    # session 3 has two lists
    plans = plans.union(plans.filter("sid = 3").withColumn("plans", F.lit("[]")))
    clicks = base.select("sid", F.lit(2).alias("click_mode")).filter("sid > 1")
    profiles = spark.range(3).select(F.col("id").alias("pid"), *[(F.col("id") * (i + 1) % 5).cast("double").alias(f"p{i}") for i in range(4)])
    ends = spark.createDataFrame([("1.00,2.00", "a", 1, "s"), ("2.00,1.00", "b", 2, "t")], "lntlat string, district string, adcode int, street_number string")
    done = blocks.session_features(base, plans, clicks, profiles, ends, components=2, raw_cols=("p0",), ellipsoid=False)
    found = {r["sid"]: r["count"] for r in done.groupBy("sid").count().collect()}
    assert found == {i: 4 if i == 3 else 1 for i in range(12)}
    assert done.columns[0] == "sid" and "plans" not in done.columns


@pytest.mark.parametrize("way", ["each column", "unpivoted"])
def test_large_parts_of_few_columns_are_joined_one_by_one(spark, monkeypatch, way):
    """no row is numbered, unpivoted and put back for a few large dictionaries; values agree with the broadcast."""
    from foldwise import session
    from foldwise.encoders import base

    data = [(1, 0.5, 7.0), (1, 0.5, 7.0), (2, None, 3.0), (None, 2.5, 3.0), (3, -1.0, None), (4, 9.0, 1.0)]
    rows = spark.createDataFrame(data, "id int, x double, y double")
    model = N.RankGauss(["x", "y"]).fit(rows)
    assert model.small
    expected = sorted(map(str, model.transform(rows).collect()))
    model.small = False
    monkeypatch.setattr(session, "BROADCAST_ROWS", 0)
    if way == "unpivoted":
        monkeypatch.setattr(base, "LARGE_COLUMNS", 0)
    done = model.transform(rows)
    assert sorted(map(str, done.collect())) == expected
    plan = done._jdf.queryExecution().analyzed().toString()
    assert ("Aggregate" in plan) == (way == "unpivoted")
