"""All registered queries."""

from . import audit_queries, cell_queries, evaluation_queries, region_queries, stream_queries  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
