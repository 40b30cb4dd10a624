"""Registered queries: every operator on the given tables, with the same question in SQL beside it."""

from . import features, jobs, models, scores, spatial, statistics, tables  # noqa: F401  (they register)
from .registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
