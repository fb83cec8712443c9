"""Queries of the reference's operators on the driver's tables, and their SQL."""

from . import audit  # noqa: F401  (registers its queries)
from .queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
