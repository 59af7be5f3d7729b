"""Sparse products and singular vectors against numpy."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F, types as T

from foldwise.encoders import projection as V, sparse as S

WIDTH = 1 << 18


def _frame(spark, vectors):
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("v", VectorUDT())])
    return spark.createDataFrame(list(enumerate(vectors)), schema)


@pytest.fixture(scope="module")
def wide(spark):
    """400 rows in 2^18 columns; column 7 is set in nine rows of ten, four others tell groups of rows apart."""
    draw = np.random.RandomState(1)
    rows = []
    for i in range(400):
        cells = {int(c): float(draw.normal() + 1) for c in draw.randint(0, 1200, 25) ** 2 % WIDTH}
        if i % 10:
            cells[7] = 15.0
        cells[200_000 + i % 4] = 12.0 - 2 * (i % 4)
        rows.append(cells)
    used = sorted({c for r in rows for c in r})
    place = {c: j for j, c in enumerate(used)}
    matrix = np.zeros((len(rows), len(used)))
    for i, r in enumerate(rows):
        for c, v in r.items():
            matrix[i, place[c]] = v
    frame = _frame(spark, [Vectors.sparse(WIDTH, sorted(r.items())) for r in rows])
    return frame.repartition(5).cache(), matrix, used


@pytest.mark.parametrize("block_bytes", [S.BLOCK_BYTES, 8 * WIDTH * 3])
def test_wide_vectors_stay_sparse(wide, monkeypatch, block_bytes):
    monkeypatch.setattr(S, "BLOCK_BYTES", block_bytes)
    frame, matrix, used = wide
    model = V.TruncatedSvd("v", 4).fit(frame)
    want = np.linalg.svd(matrix, compute_uv=False)[:4]
    assert np.allclose(model.params["singular"], want, rtol=1e-9)
    v = model.loadings
    assert v.shape == (WIDTH, 4)
    mine = v[used]
    assert np.allclose(mine.T @ mine, np.eye(4), atol=1e-8)  # nothing outside the columns in use
    off = matrix.T @ (matrix @ mine) - mine * want**2
    assert np.abs(off).max() <= 1e-7 * want[0] ** 2
    assert model.params["residual"] <= 1e-9
    got = model.transform(frame).orderBy("id").select(*model.feature_names()).toPandas().to_numpy()
    assert np.allclose(got, matrix @ mine, atol=1e-8)


def test_explained_ratio_of_wide_vectors(wide):
    frame, matrix, used = wide
    loadings = np.zeros((WIDTH, 2))
    loadings[[7, 200_001], [0, 1]] = 1.0
    model = V.SvdModel({"source": "v", "outs": ["a", "b"], "loadings": loadings})
    want = (matrix @ loadings[used]).var(axis=0).sum() / matrix.var(axis=0).sum()
    assert model.explained_ratio(frame) == pytest.approx(want, rel=1e-9)


def test_fewer_directions_than_asked(spark):
    """Rank one, more than ``NARROW`` columns: the other components are orthonormal and score zero."""
    cells = [(3, 1.0), (500, 2.0)]
    frame = _frame(spark, [Vectors.sparse(1000, [(c, v * t) for c, v in cells]) for t in (1.0, 2.0, -1.0)])
    model = V.TruncatedSvd("v", 3).fit(frame)
    assert model.params["singular"] == pytest.approx([np.sqrt(30), 0, 0], abs=1e-6)
    assert np.allclose(model.loadings.T @ model.loadings, np.eye(3), atol=1e-8)
    got = model.transform(frame).orderBy("id").select(*model.feature_names()).toPandas().to_numpy()
    assert np.allclose(np.abs(got), np.sqrt(5) * np.array([[1, 0, 0], [2, 0, 0], [1, 0, 0]]), atol=1e-6)


def test_null_empty_and_mixed_vectors(spark):
    vectors = [Vectors.dense([1.0, 0.0, 2.0]), None, Vectors.sparse(3, []), Vectors.sparse(3, [(1, 4.0)]), Vectors.dense([0.5, 1.0, 1.0])]
    frame = _frame(spark, vectors)
    model = V.TruncatedSvd("v", 3).fit(frame)
    matrix = np.array([[1.0, 0, 2], [0, 0, 0], [0, 4, 0], [0.5, 1, 1]])  # of rank two: the last value is zero but for noise
    assert np.allclose(model.params["singular"], np.linalg.svd(matrix, compute_uv=False), atol=1e-7)
    got = [list(r) for r in model.transform(frame).orderBy("id").select(*model.feature_names()).collect()]
    assert got[1] == [None, None, None]
    assert np.allclose([got[i] for i in (0, 2, 3, 4)], matrix @ model.loadings)
    assert S.total_variance(frame, "v") == pytest.approx(matrix.var(axis=0).sum())
    with pytest.raises(ValueError):
        V.TruncatedSvd("v", 1).fit(frame.limit(0))


def test_steps_within_a_batch(monkeypatch):
    """Rows of many lengths, cut into steps of three entries."""
    monkeypatch.setattr(S, "STEP", 6)
    draw = np.random.RandomState(2)
    matrix = draw.normal(size=(30, 11)) * (draw.uniform(size=(30, 11)) < draw.uniform(size=(30, 1)))
    row, at = np.nonzero(matrix)
    lengths = np.bincount(row, minlength=30)
    block = draw.normal(size=(11, 2))
    products = S.row_products(at, matrix[row, at], lengths, block)
    assert np.allclose(products, matrix @ block)
    total = np.zeros((11, 2))
    S.add_products(total, at, matrix[row, at], lengths, products)
    assert np.allclose(total, matrix.T @ matrix @ block)


def test_distances_of_sparse_rows(wide):
    frame, _, _ = wide
    rows = frame.filter("id < 20")
    model = V.RbfModel({"source": "v", "outs": [], "centres": {"2": np.eye(2, WIDTH, 6).tolist()}, "gamma": 0.1})
    got = model.transform(rows).select("v", "cluster_rbf_2").collect()
    for r in got:
        dense = r["v"].toArray()
        want = [np.exp(-0.1 * np.linalg.norm(dense - np.eye(1, WIDTH, c)[0])) for c in (6, 7)]
        assert r["cluster_rbf_2"] == pytest.approx(want, rel=1e-9)


def test_no_folder_is_left(wide, spark):
    from foldwise.session import checkpoint_dir, paths_like

    frame, _, _ = wide
    before = paths_like(spark, f"{checkpoint_dir(spark)}/table-*")
    V.TruncatedSvd("v", 1).fit(frame)
    assert paths_like(spark, f"{checkpoint_dir(spark)}/table-*") == before


def test_dense_form_is_the_same(wide):
    """A narrow slice through the exact path equals the vectors made dense."""
    frame, _, _ = wide
    from pyspark.sql import functions as F

    few = frame.select("id", *[vector_to_array("v")[c].alias(f"c{c}") for c in (7, 0, 1, 4, 9)]).filter(F.col("id") < 50)
    model = V.TruncatedSvd(["c7", "c0", "c1", "c4", "c9"], 2).fit(few)
    dense = few.orderBy("id").drop("id").toPandas().to_numpy()
    assert np.allclose(model.params["singular"], np.linalg.svd(dense, compute_uv=False)[:2])


def test_total_of_a_vector_too_wide_for_a_dense_one(spark):
    rows = [Vectors.sparse(2**31 - 1, [5, 2**31 - 2], [1.0, 2.0]), Vectors.sparse(9, [], []), Vectors.dense(1.0, 0.5), None]
    found = _frame(spark, rows).select("id", S.total(F.col("v")).alias("t")).orderBy("id").collect()
    assert [r["t"] for r in found] == [3.0, 0.0, 1.5, None]


def test_narrow_sums_are_those_of_sorted_entries():
    from foldwise.encoders import sparse as S

    rng = np.random.default_rng(6)
    full = rng.normal(size=(50, 7)) * (rng.random((50, 7)) < 0.4)
    lengths, at = (full != 0).sum(1), np.nonzero(full)[1]
    value, block = full[full != 0], rng.normal(size=(7, 3))
    one, two = np.zeros((7, 3)), np.zeros((7, 3))
    S.add_narrow(one, at, value, lengths, block)
    S.add_products(two, at, value, lengths, S.row_products(at, value, lengths, block))
    assert np.allclose(one, two) and np.allclose(one, full.T @ full @ block)


def test_text_components_parse_no_list_again(spark):
    """The components are row-wise work on a written table: no list is parsed and no text cut for them again."""
    from foldwise.encoders.blocks import plan_text_components

    rows = spark.createDataFrame([(i, f"word_{i % 3} word_{i % 4}") for i in range(24)], "id long, t string").coalesce(2)
    made = plan_text_components(rows.selectExpr("id", "reverse(reverse(t)) as mode_text"), 2)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "reverse" not in plan and made.count() == 24
