"""Registered queries, their check SQL and the bench set."""

from . import event_queries, feed_queries, scoring_queries, search_queries, stream_queries  # noqa: F401
from .catalog import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
