"""Registry of the direction-analytics queries and their SQL twins."""

from __future__ import annotations

from . import eval_queries, model_queries, panel_queries, stream_queries, sweep_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
