"""Queries over pairs of documents: near duplicates and repeated passages."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.llm import near_duplicates, repeated_bytes, repeated_passages
from foldwise.llm.registry import query, table


@query("op10_probminhash_classes")
def op10(spark, sf_dir):
    found = near_duplicates.classes(table(spark, sf_dir, "documents"))
    # classes whose smallest id is the same or null differ in their hash
    head = (F.col("doc_id") == F.col("class_id")).alias("is_head")
    return found.select("doc_id", "class_id", head, F.hex("label").alias("class_hash"))


@query("op8_block_anchors")
def op8(spark, sf_dir):
    found = repeated_passages.remove_repeats(table(spark, sf_dir, "documents"), with_text=False)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op6_linear_grouping")
def op6(spark, sf_dir):
    found = repeated_bytes.remove_repeats(table(spark, sf_dir, "documents"), with_text=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
