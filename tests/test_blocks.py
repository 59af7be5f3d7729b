"""Tables of blocks that learners read many times."""

import numpy as np
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from foldwise.plans import blocks as B
from foldwise.session import paths_like, checkpoint_dir


def _kept(spark):
    return set(paths_like(spark, f"{checkpoint_dir(spark)}/*"))


def test_blocks_are_dealt_and_deleted(spark, monkeypatch):
    """Rows of one partition come back whole from several, and no table outlives its reader."""
    monkeypatch.setattr(B, "BLOCK_BYTES", 80)
    before = _kept(spark)
    rows = spark.range(1000).select(F.array(F.col("id").cast("double")).alias("x")).coalesce(1)

    cut = list(B.stretches(1005, 1))
    assert len(cut) == 101 and cut[-1] == slice(1000, 1005)
    with B.Blocks(["x"]) as table:
        table.write(rows, lambda batch: [[B.matrix(batch.column(0), 1)[k : k + 10]] for k in range(0, batch.num_rows, 10)], deal=True)
        filled = table.rows.groupBy(F.spark_partition_id()).count().count()
        assert filled > 1
        table.write(table.rows, lambda batch: [[np.frombuffer(batch.column(0)[k].as_buffer()) * 2] for k in range(batch.num_rows)])
        total = table.sums(lambda found: np.array([sum(np.frombuffer(b[0]).sum() for b in found), 0.0]), 2)
    assert total.tolist() == [999000.0, 0.0]
    assert _kept(spark) == before


def test_joint_fit_leaves_nothing(spark):
    from foldwise.plans.factorisation import SoftmaxFM

    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 2))
    df = spark.createDataFrame([(Vectors.dense(v), float(v[0] > 0)) for v in x.tolist()], ["features", "label"]).coalesce(1)
    before = _kept(spark)
    SoftmaxFM(2, factors=2, max_iter=5).fit(df)
    assert _kept(spark) == before


def test_trees_by_masks_and_by_steps():
    """Both ways down a tree end at the same nodes, also above early leaves."""
    from foldwise.plans import boosting as G

    rng = np.random.default_rng(4)
    bins = rng.integers(0, 9, (3, 500)).astype(np.uint8)
    tree = G.Tree.empty(4)
    for i in range(15):
        if i == 0 or (tree.feature[(i - 1) // 2] >= 0 and i % 5):
            tree.feature[i], tree.bin[i] = i % 3, int(rng.integers(1, 8))
    deep = G.Tree(*(np.append(a, np.full(2**9 - 1 - len(a), -1)) for a in (tree.feature, tree.bin, tree.value)))
    assert len(tree.feature) <= G.MASKED_NODES < len(deep.feature)
    assert len(set(tree.nodes(bins).tolist())) > 4
    assert tree.nodes(bins).tolist() == deep.nodes(bins).tolist()


def test_boosting_leaves_nothing_and_deals_its_rows(spark, monkeypatch):
    from foldwise.plans import boosting as G

    seen = []
    close = B.Blocks.close
    monkeypatch.setattr(B.Blocks, "close", lambda self: (seen.append(self.rows.columns), close(self)))
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(Vectors.dense(v), float(v[0] > 0)) for v in rng.normal(size=(80, 2)).tolist()], ["features", "label"]).coalesce(1)
    before = _kept(spark)
    model = G.Boosting("logistic", rounds=9, depth=1).fit(df)
    assert seen == [["bins", "y", "w", "m"]] and _kept(spark) == before
    assert model.transform(df).filter("prediction = label").count() >= 76


def test_a_file_of_one_row_group_is_dealt_to_all_cores(spark, tmp_path):
    """a scan of many splits of which one holds all rows is dealt; an even one stays as it is."""
    from foldwise.session import spread

    cores = spark.sparkContext.defaultParallelism
    spark.range(40_000).selectExpr("id", "uuid() as t").coalesce(1).write.parquet(str(tmp_path / "one"))
    spark.range(40_000).selectExpr("id", "uuid() as t").repartition(4 * cores).write.parquet(str(tmp_path / "many"))
    limits = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(c) for c in limits]
    try:
        size = sum(p.stat().st_size for p in (tmp_path / "one").glob("*.parquet"))
        spark.conf.set(limits[0], str(size // (3 * cores)))
        spark.conf.set(limits[1], "0")
        one = spark.read.parquet(str(tmp_path / "one"))
        assert one.rdd.getNumPartitions() >= cores
        rows = lambda df: df.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()
        assert max(rows(one)) == 40_000
        dealt = spread(one)
        found = rows(dealt)
        assert sum(found) == 40_000 and max(found) * cores <= 2 * 40_000
        assert dealt.select("id").distinct().count() == 40_000
        spark.conf.set(limits[1], str(size))  # one file is one split
        many = spark.read.parquet(str(tmp_path / "many"))
        assert spread(many) is many
    finally:
        for c, v in zip(limits, before):
            spark.conf.set(c, v)
