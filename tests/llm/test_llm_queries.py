"""Every query of the subpackage that has SQL, against it."""

import pytest
from compare import ROOT, compare

from foldwise.llm.catalogue import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    assert compare(spark, name, QUERIES[name], ORACLES[name], f"{ROOT}/sf0.001") is None
