import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from foldwise.session import ship_package


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship_package(spark)


ODD_TEXTS = [
    None,
    "",
    " \n\t ",
    "one",
    "a b c a b c a b c",
    "é à ü " * 40,
    "x" * 5000,
    ("the quick brown fox jumps over the lazy dog and runs away from the big bad wolf today " * 3).strip(),
    "# $ % & * | < > line\nline\nline\n\n \nend",
]


@pytest.fixture(scope="session")
def docs(spark):
    """The smallest documents, odd texts, repeated rows, and columns named like internal ones."""
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(9000 + i, t, "en", "odd", None) for i, t in enumerate(ODD_TEXTS)] + [(9000, "one", None, None, 1)]
    return base.unionByName(spark.createDataFrame(rows, base.schema))
