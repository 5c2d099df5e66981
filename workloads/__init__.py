"""Registered queries over the driver tables, and the SQL each is checked against."""

from workloads import q_market, q_postings, q_sources, q_streams  # noqa: F401  (registration)
from workloads.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
