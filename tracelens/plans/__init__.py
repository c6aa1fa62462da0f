"""Queries over the test tables."""

from . import assembly_queries, flow_queries, ingest_queries, profile_queries, source_queries, state_queries, store_queries, text_queries
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "assembly_queries", "flow_queries", "profile_queries", "store_queries", "text_queries"]
