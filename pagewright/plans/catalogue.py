"""Every named query and its DuckDB twin."""

from __future__ import annotations

from pagewright.plans import on_documents, on_events, on_layout, on_sampling, on_stages, on_streams, on_text, on_views
from pagewright.plans.named import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "on_documents", "on_events", "on_layout", "on_sampling", "on_stages", "on_streams", "on_text", "on_views"]
