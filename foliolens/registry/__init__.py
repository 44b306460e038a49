"""Registered queries: each operator over the benchmark tables, with its SQL."""

from __future__ import annotations

import importlib

MODULES = ["criteria_queries", "view_queries", "source_queries", "output_queries", "metric_queries", "audit_queries"]


def registered() -> dict:
    """``{name: (function of (spark, folder), SQL or None)}``."""
    found = {}
    for name in MODULES:
        found |= importlib.import_module(f"foliolens.registry.{name}").QUERIES
    return found
