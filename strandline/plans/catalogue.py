"""The queries by name, each with the SQL that says what it returns where SQL can."""

from __future__ import annotations

from . import grid_queries, measure_queries, study_queries  # noqa: F401
from .base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
