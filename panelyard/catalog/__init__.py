"""Registered queries over the star-schema tables, each with its SQL check where SQL can express it."""

from __future__ import annotations

from importlib import import_module

MODULES = ["source_queries", "scalar_queries", "join_queries", "group_queries", "window_queries", "feature_queries",
           "evaluation_queries", "report_queries", "text_queries"]


def load():
    """(queries, checks) with every query module imported."""
    for name in MODULES:
        import_module(f"panelyard.catalog.{name}")
    from panelyard.catalog.fragments import with_fragments
    from panelyard.catalog.registry import CHECKS, QUERIES

    return QUERIES, {name: with_fragments(body) for name, body in CHECKS.items()}
