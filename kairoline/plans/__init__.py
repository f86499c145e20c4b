"""Queries over the driver's tables, by name, and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("moment_queries", "time_queries", "timeline_queries", "signal_queries", "look_queries", "misc_queries", "edit_queries", "more_queries", "row_queries", "shape_queries", "export_queries")


def registered() -> tuple[dict, dict]:
    found, sql = {}, {}
    for name in MODULES:
        module = import_module(f"{__name__}.{name}")
        found |= module.QUERIES
        sql |= module.ORACLE_SQL
    return found, sql
