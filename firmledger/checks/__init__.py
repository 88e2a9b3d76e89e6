"""Registered queries over the test tables, each beside the plain SQL that states the same result."""

from .registry import all_queries, all_sql

__all__ = ["all_queries", "all_sql"]
