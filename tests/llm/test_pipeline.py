"""The pipeline, stage by stage, against plain Python on its own input."""

import pytest
from test_near_duplicates import near_copies, plain_classes
from test_packing import check
from test_secrets import plain as plain_secrets
from test_text_rules import plain_contamination, plain_quality

import corpus_pipeline
from foldwise.llm import quality
from foldwise.session import settle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, docs):
    """Input and output of every stage."""
    from test_secrets import odd_docs

    table = settle(near_copies(spark, odd_docs(spark, docs)))
    out = [table]
    for _, stage in corpus_pipeline.STAGES:
        out.append(settle(stage(spark, out[-1], SF)))
    return out


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_columns(steps, docs):
    for df in steps[1:-1]:
        assert df.columns == docs.columns and df.count() > 50


def test_quality(steps):
    want = []
    for d, t in rows(steps[0]):
        n, _, _, _, repeat, covered, longest = plain_quality(t)
        bad = n < 50 or 100 * repeat > 50 * n
        if not bad and covered <= quality.MAX_COVERED * n and longest <= quality.MAX_LONGEST:
            want.append(d)
    assert sorted(d for d, _ in rows(steps[1])) == sorted(want)


def test_near_duplicates(steps):
    heads = {h for _, h in plain_classes(rows(steps[1]))}
    assert sorted(d for d, _ in rows(steps[2])) == sorted(heads)


def test_decontamination(spark, steps):
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = sorted(d for d, t in rows(steps[2]) if not plain_contamination(t, items)[-1])
    assert sorted(d for d, _ in rows(steps[3])) == want and len(want) < steps[2].count()


def test_secrets(steps):
    before, after = dict(rows(steps[3])), dict(rows(steps[4]))
    assert before.keys() == after.keys()
    for d, t in before.items():
        assert (after[d] == t) == (not plain_secrets(t)) and not plain_secrets(after[d])


def test_packing(steps):
    assert check(steps[5].collect(), rows(steps[4])) <= 1


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 50
