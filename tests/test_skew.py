"""Heavy keys: the segmented and scattered forms give what the plain forms give."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from foldwise.encoders import blocks
from foldwise.operators import aggregates as A, ordering as O, rows as R, skew as S, windows as W


@pytest.fixture(scope="module")
def events(spark):
    rnd = random.Random(5)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(3000):
        key = -1 if rnd.random() < 0.6 else rnd.randrange(40)
        # many equal times, so cut points fall between rows of one time
        rows.append((i, key, start + dt.timedelta(minutes=rnd.randrange(150)), rnd.choice([-1] + list(range(5)) * 12), rnd.choice([None, 1, 2, 3])))
    return spark.createDataFrame(rows, "sid int, pid int, ts timestamp, mode int, extra int").repartition(6).cache()


def both(df, make):
    """The same operator with every group in one piece, and with heavy groups cut."""
    plain = make(dict(min_rows=10**9)).orderBy("sid").toPandas()
    cut = make(dict(min_rows=200, pieces=7)).orderBy("sid").toPandas()
    columns = sorted(plain.columns)
    assert sorted(cut.columns) == columns
    pd.testing.assert_frame_equal(plain[columns], cut[columns])
    return plain


def test_heavy_group_is_cut(events):
    groups = S.OrderedGroups(events, ["pid"], ["ts", "sid"], 200, 7)
    sizes = groups.df.filter("pid = -1").groupBy("_seg").count().collect()
    assert groups.split and len(sizes) >= 5
    assert max(r["count"] for r in sizes) < 900
    assert groups.df.filter("pid <> -1").select("_seg").distinct().collect() == [(0,)]


def test_lag(events):
    out = both(events, lambda o: W.lag_by(events, ["pid"], ["ts", "sid"], "extra", "last", 0, **o))
    hot = out[out.pid == -1].sort_values(["ts", "sid"])
    want = hot["extra"].shift(1).fillna(0).astype(int).tolist()
    assert hot["last"].tolist() == want


def test_history_share_and_mode(events):
    out = both(events, lambda o: W.history_share(events, ["pid"], ["ts", "sid"], "mode", 5, **o).result())
    hot = out[out.pid == -1].sort_values(["ts", "sid"])
    modes = hot["mode"].tolist()
    for place in (0, 1, 5, 200, 900, len(modes) - 1):
        past = modes[:place]
        past = past[: past.index(-1)] if -1 in past else past
        for c in range(5):
            assert hot[f"mode_num_{c}"].iloc[place] == pytest.approx(past.count(c) / len(past) if past else 0.0)
    both(events, lambda o: W.history_mode(events, ["pid"], ["ts", "sid"], "mode", 5, **o))


def test_history_list(events):
    out = both(events, lambda o: W.history_list(events, ["pid"], ["ts", "sid"], "extra", "h", 4, **o))
    hot = out[out.pid == -1].sort_values(["ts", "sid"])
    values = [None if pd.isna(v) else int(v) for v in hot["extra"]]
    for place in (0, 2, 700, len(values) - 1):
        assert [None if pd.isna(v) else int(v) for v in hot["h"].iloc[place]] == values[max(0, place - 4) : place]


def test_whole_history(events):
    out = both(events, lambda o: W.history_list(events, ["pid"], ["ts", "sid"], "extra", "h", **o))
    hot = out[out.pid == -1].sort_values(["ts", "sid"])
    values = [None if pd.isna(v) else int(v) for v in hot["extra"]]
    for place in (0, 2, 700, len(values) - 1):
        assert [None if pd.isna(v) else int(v) for v in hot["h"].iloc[place]] == values[:place]


def test_whole_history_as_text(events, monkeypatch):
    """Blocks of every kind: smaller than a group, of one row, larger than all groups; null keys, null and empty values."""
    rows = [(0, None, "a"), (1, None, None), (2, None, "\u00fc"), (3, None, ""), (4, 1, None), (5, 1, "b"), (6, None, "c"), (7, None, "d")]
    table = events.sparkSession.createDataFrame(rows, "sid int, pid int, t string")
    want = {0: "", 1: "a", 2: "a", 3: "a; \u00fc", 6: "a; \u00fc; ", 7: "a; \u00fc; ; c", 4: "", 5: ""}
    lists = {0: [], 1: ["a"], 4: [], 5: [None], 7: ["a", None, "\u00fc", "", "c"]}
    for block in (1, 3, 100):
        monkeypatch.setattr(S, "BLOCK_ROWS", block)
        got = W.history_list(table, ["pid"], ["sid"], "t", "h", sep="; ").collect()
        assert {r["sid"]: r["h"] for r in got} == want
        got = {r["sid"]: r["h"] for r in W.history_list(table, ["pid"], ["sid"], "t", "h").collect()}
        assert len(got) == 8 and {k: got[k] for k in lists} == lists
    both(events, lambda o: W.history_list(events, ["pid"], ["ts", "sid"], "extra", "h", sep=",", **o))


def test_whole_history_of_a_group_is_dealt(events, monkeypatch):
    """The rows of one group are written by several tasks, each with its front alone."""
    monkeypatch.setattr(S, "BLOCK_ROWS", 100)
    out = W.history_list(events.filter("pid = -1"), ["pid"], ["ts", "sid"], "extra", "h", sep=",")
    sizes = out.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) >= 4 and max(r["count"] for r in sizes) < 1000


def test_numbered(events):
    rows = R.numbered(R.sort(events, ["ts", "sid"])).orderBy("place").select("place", "ts", "sid").collect()
    assert [r["place"] for r in rows] == list(range(1, 3001))
    assert [(r["ts"], r["sid"]) for r in rows] == sorted((r["ts"], r["sid"]) for r in rows)


def test_running_counts(events):
    out = both(events, lambda o: W.running_counts(events, ["pid"], "ts", "mode", 5, **o))
    hot = out[out.pid == -1]
    row = hot.sort_values(["ts", "sid"]).iloc[800]
    assert row["till_now_2"] == ((hot["mode"] == 2) & (hot["ts"] <= row["ts"])).sum()


def test_list_rank(events):
    out = both(events, lambda o: W.list_rank(events, ["pid"], ["ts", "sid"], **o))
    assert sorted(out[out.pid == -1]["rank"]) == list(range(1, (out.pid == -1).sum() + 1))


def test_history_block(events):
    both(events, lambda o: blocks.history_features(events, "pid", "ts", "sid", "mode", 5, **o))


def test_null_key_is_one_heavy_group(events):
    rows = events.withColumn("pid", F.when(F.col("pid") != -1, F.col("pid")))
    both(rows, lambda o: W.lag_by(rows, ["pid"], ["ts", "sid"], "mode", "last", 0, **o))


def test_lookup_with_heavy_key(spark, events):
    table = events.groupBy("pid").agg(F.sum("sid").alias("total"))
    heavy = S.heavy_keys(events, ["pid"], 200, 7)
    assert [r["pid"] for r in heavy] == [-1]
    shuffled = S.lookup(events, table, ["pid"], small=False, heavy=heavy)
    plain = events.join(table, "pid", "left")
    assert sorted(shuffled.select("sid", "total").collect()) == sorted(plain.select("sid", "total").collect())


def test_lookup_null_meets_null(spark):
    left = spark.createDataFrame([(1, None), (2, "a"), (3, "b")], "id int, k string")
    table = spark.createDataFrame([(None, 10), ("a", 20)], "k string, v int")
    for small in (True, False):
        got = sorted(S.lookup(left, table, ["k"], small=small).select("id", "v").collect())
        assert got == [(1, 10), (2, 20), (3, None)]


def test_ranks_and_quantiles(spark):
    rnd = random.Random(3)
    values = [0.0] * 700 + [rnd.gauss(0, 1) for _ in range(900)] + [None] * 5
    df = spark.createDataFrame([(i, v, i % 3) for i, v in enumerate(values)], "id int, x double, g int").repartition(5)
    s = pd.Series(values).dropna()
    counts = O.ordered_counts(df, "x", pieces=9)
    ranks = {r["value"]: r["rank"] for r in O.average_rank_of(counts).collect()}
    want = s.rank(method="average")
    assert all(ranks[v] == pytest.approx(r) for v, r in zip(s, want))
    qs = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    got = O.quantiles_of(counts, qs).first()
    for i, q in enumerate(qs):
        assert got[f"q{i}"] == pytest.approx(s.quantile(q))
    frame = pd.DataFrame({"x": values, "g": [i % 3 for i in range(len(values))]})
    medians = {r["g"]: r["median"] for r in A.grouped_median(df, ["g"], "x").collect()}
    for g, m in frame.groupby("g")["x"].median().items():
        assert medians[g] == pytest.approx(m)


def test_constant_and_empty_columns(spark):
    df = spark.createDataFrame([(i, 4.0, None) for i in range(30)], "id int, a double, b double")
    row = {r["feature"]: r for r in A.describe(df, ["a", "b"]).collect()}
    assert row["a"]["q25"] == row["a"]["q75"] == 4.0 and row["a"]["std"] == 0.0
    assert row["b"]["count"] == 0 and row["b"]["q50"] is None


def test_stratified_folds_of_a_heavy_label(spark):
    df = spark.range(5000).select(F.col("id"), F.when(F.col("id") % 100 == 0, "rare").otherwise("usual").alias("y"))
    one = spark.createDataFrame([(10**6, "single")], "id long, y string")
    done = R.stratified_kfold(df.unionByName(one), "id", "y", 5, 1)
    sizes = done.groupBy("y", "fold").count().toPandas()
    for label, n in (("rare", 50), ("usual", 4950)):
        part = sizes[sizes.y == label]["count"]
        assert len(part) == 5 and part.sum() == n and part.max() - part.min() <= 1
    assert done.count() == 5001


@pytest.mark.parametrize("frac", [0.0, 0.013, 0.5, 1.0])
def test_exact_sample(spark, frac):
    df = spark.range(997)
    assert R.sample_exact(df, "id", frac, 3).count() == int(frac * 997)
    assert R.sample_exact(df, "id", frac, 3).distinct().count() == int(frac * 997)


def test_dedupe_and_arg_extreme_ties(spark):
    rows = [(1, 1, 5.0, 7), (1, 2, 5.0, 8), (1, 3, 1.0, 9), (1, 4, 1.0, 6), (2, 1, None, 3)]
    df = spark.createDataFrame(rows, "k int, pos int, v double, mode int")
    edge = A.arg_extreme(df, ["k"], ["v"], ["pos"], "mode").filter("k = 1").first()
    first = A.arg_extreme(df, ["k"], ["v"], ["pos"], "mode", "first").filter("k = 1").first()
    assert (edge["max_v_mode"], edge["min_v_mode"]) == (8, 9)
    assert (first["max_v_mode"], first["min_v_mode"]) == (7, 9)
    assert A.dedupe(df, ["k"], ["pos"], "last").filter("k = 1").first()["mode"] == 6
    assert A.multi_hot(df, ["k"], "mode", 10).filter("k = 1").first()["mode_feas_7"] == 1
