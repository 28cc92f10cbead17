"""All queries of the engine with their SQL counterparts, by name."""

from __future__ import annotations

from . import geo_queries, judge_queries, model_queries, report_queries, series_queries, stats_queries, system_queries  # noqa: F401
from .tables import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
