"""All registered queries."""

from foldwise.plans import encoder_queries, history_queries, model_queries, relational  # noqa: F401
from foldwise.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
