"""All registered queries; importing the modules fills the registry."""

from sentspark.plans import metric_queries, text_queries, vector_queries  # noqa: F401
from sentspark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
