"""Whole reports, and the queries registered for checking against SQL."""

from tarnlake.plans import audit_queries, basic_queries, table_queries  # noqa: F401
from tarnlake.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
