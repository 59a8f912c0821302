"""Registered queries and the SQL they are checked against."""

from __future__ import annotations

from importlib import import_module

MODULES = ["profile", "cleaning", "relations", "distributions", "features", "charting"]


def load():
    """All queries and all SQL, by name."""
    from checks.base import ORACLE, QUERIES

    for name in MODULES:
        import_module(f"checks.{name}")
    return QUERIES, ORACLE
