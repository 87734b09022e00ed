"""Every registered query with its DuckDB oracle."""

from __future__ import annotations

from lectern.plans import asking_queries, character_queries, detail_queries, entity_queries, graph_queries, location_queries, model_queries, reading_queries, relational_queries, retrieval_queries, stream_queries, text_queries  # noqa: F401
from lectern.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
