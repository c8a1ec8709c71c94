"""Queries over the driver's tables, one or more for each operator, and their SQL for comparison."""

from __future__ import annotations

from .catalog import scores, texts

AREAS = (texts, scores)


def queries() -> dict:
    return {f.__name__: f for area in AREAS for f in area.QUERIES}


def oracle_sql() -> dict:
    return {name: sql for area in AREAS for name, sql in area.SQL.items()}
