"""All queries of the engine and their SQL."""

from __future__ import annotations

from weftlake.plans import analysis_queries, mining_queries, relational_queries, serving_queries  # noqa: F401  registers them
from weftlake.plans.catalog import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
