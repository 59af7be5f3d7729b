"""Queries over whole texts: contamination, quality, toxicity, secrets."""

from __future__ import annotations

from foldwise.llm import decontaminate, quality, secrets, toxicity
from foldwise.llm.registry import query, table


@query("op2_benchmark_decontamination")
def op2(spark, sf_dir):
    found = decontaminate.find_contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"]
    )
    return decontaminate.digest(found)


@query("op3_suffix_quality")
def op3(spark, sf_dir):
    rated = quality.measure(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return rated.select(
        "doc_id", "quality.*", quality.base_failed().alias("base_failed"), quality.kept().alias("kept")
    )


@query("op9_trigram_secrets", secrets.oracle())
def op9(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.digest(secrets.find_secrets(docs))


@query("op7_grammar_toxicity")
def op7(spark, sf_dir):
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
