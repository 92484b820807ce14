"""Registered queries."""

from importlib import import_module

MODULES = ("relational", "text", "labels", "learning", "flows")


def all_queries():
    """All registered queries by name."""
    for name in MODULES:
        import_module(f"tidemark.plans.{name}")
    from tidemark.plans.base import QUERIES

    return QUERIES
