"""Registered queries: each runs the library over the given tables, with the same result in plain SQL.

Tables stand in for the domain's sources (``standins``); both sides use the same stand-in text.
"""

from __future__ import annotations

from importlib import import_module

from queries.registry import ORACLES, QUERIES

for _theme in ("spatial", "enrichment", "scoring", "prices", "weather", "landing", "values", "summaries", "market_gap"):
    import_module(f"queries.{_theme}")

__all__ = ["ORACLES", "QUERIES"]
