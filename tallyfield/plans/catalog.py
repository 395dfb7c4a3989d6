"""All queries of the library and their SQL."""

from __future__ import annotations

from . import contests, grading, jobs, models, plays, ratings, stored  # noqa: F401  each registers its queries
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
