"""Collects every query module; importing it fills the registry."""

from talloom.plans import corpus_queries, flow_queries, session_queries, source_queries, stream_queries, text_queries  # noqa: F401
from talloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
