"""All queries of the engine and their SQL."""

from aerolith.plans import grid_queries, observed_queries  # noqa: F401  they register their queries
from aerolith.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
