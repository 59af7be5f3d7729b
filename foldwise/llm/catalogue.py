"""All registered queries of this subpackage."""

from foldwise.llm import queries_files, queries_pairs, queries_text, queries_web  # noqa: F401
from foldwise.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
