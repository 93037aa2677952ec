"""Queries over the driver's tables."""

from __future__ import annotations

from importlib import import_module

MODULES = ("scalar_queries", "detect_queries", "ingest_queries", "stream_queries", "extra_queries")


def catalog():
    """All registered queries, importing the modules that declare them."""
    from actiontrail.plans.registry import QUERIES

    for name in MODULES:
        try:
            import_module(f"actiontrail.plans.{name}")
        except ModuleNotFoundError as err:
            if err.name != f"actiontrail.plans.{name}":
                raise
    return dict(QUERIES)
