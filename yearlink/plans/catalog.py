"""All registered queries: importing this module loads every query module."""

from yearlink.plans import (  # noqa: F401
    queries_chain,
    queries_fallback,
    queries_final,
    queries_match,
    queries_report,
    queries_search,
)
from yearlink.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
