"""Every registered query at the smallest scale, against its SQL where it has one."""

import pytest
from compare import ROOT, compare

from __spark_entry__ import entry, oracle_sql, queries

SF = f"{ROOT}/sf0.001"
QUERIES = queries()
ORACLES = oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    assert compare(spark, name, QUERIES[name], ORACLES.get(name), SF) is None


def test_entry(spark):
    assert entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
