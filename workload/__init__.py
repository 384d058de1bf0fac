"""The registered queries, their inputs derived from the given tables, and their SQL checks."""

from __future__ import annotations

from importlib import import_module

from . import catalog

MODULES = ("cells_queries", "text_queries", "loop_queries", "rule_queries", "plan_queries")


def load():
    """(queries, oracle SQL), in a stable order."""
    for name in MODULES:
        import_module(f"{__name__}.{name}")
    return dict(catalog.QUERIES), dict(catalog.ORACLES)
