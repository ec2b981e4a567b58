"""Queries over the given tables."""

from . import q_events, q_basics, q_prep, q_metrics, q_models, q_serving, q_streaming, q_properties  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
