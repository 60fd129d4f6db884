"""Every registered query, and the SQL that checks it."""

from __future__ import annotations

from . import canopy, labels, layers, scenes

_ALL = scenes.QUERIES | canopy.QUERIES | labels.QUERIES | layers.QUERIES


def queries() -> dict:
    return {name: fn for name, (fn, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql is not None}
