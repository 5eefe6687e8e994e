"""The named queries of the core and the SQL that each is held against."""

from __future__ import annotations

from corpusflow.plans import corpus_queries, log_queries, pipeline_queries, search_queries, text_queries, user_queries  # noqa: F401
from corpusflow.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
