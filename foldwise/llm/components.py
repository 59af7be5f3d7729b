"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from foldwise.session import settle


def components(links: DataFrame) -> DataFrame:
    """Smallest node of its component for every node of ``links`` (a, b): rows (node, label).

    Each round gives a node the smallest label among its own and its
    neighbours', then the label of that label, so distances halve. It ends when
    no neighbour has a smaller label. Every round is written, and joins start
    from written tables, so Spark may split the rows of a node with many links.
    """
    both = settle(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct())
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")))
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        lower = settle(
            labels.join(near, "node").select("node", "label", F.least("label", "near").alias("low"))
        )
        if lower.filter("low <> label").isEmpty():
            return labels
        jump = lower.select(F.col("node").alias("low"), F.col("low").alias("next"))
        labels = settle(
            lower.join(jump, "low", "left").select("node", F.least("low", F.coalesce("next", "low")).alias("label"))
        )


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (node, label) after more links; a node without a row is a component of its own.

    Only links between different components count, as links between their
    labels, so the rounds run on the components that meet, not on all nodes.
    """
    ends = links.select("a", "b")
    for end in ("a", "b"):
        own = labels.select(F.col("node").alias(end), F.col("label").alias(f"_{end}"))
        ends = ends.join(own, end, "left").withColumn(end, F.coalesce(f"_{end}", end)).drop(f"_{end}")
    between = settle(ends.filter("a <> b").distinct())
    if between.isEmpty():
        return labels
    moved = components(between)
    target = moved.select(F.col("node").alias("label"), F.col("label").alias("new"))
    known = labels.join(target, "label", "left").select("node", F.coalesce("new", "label").alias("label"))
    return settle(known.unionByName(moved.join(labels.select("node"), "node", "left_anti")))
