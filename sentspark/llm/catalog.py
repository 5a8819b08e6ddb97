"""All queries of the package; importing the modules fills the registry."""

from sentspark.llm import conversation_queries, pair_queries, table_queries, text_queries  # noqa: F401
from sentspark.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
