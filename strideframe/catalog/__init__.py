"""All registered queries with the SQL text of their DuckDB twins."""

from __future__ import annotations

from importlib import import_module

FAMILIES = ("edges", "paths", "nearby", "requests", "layers", "graphs", "plans", "streams")


def _modules():
    return [import_module(f"strideframe.catalog.{name}") for name in FAMILIES]


def queries() -> dict:
    return {name: fn for m in _modules() for name, fn in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: text for m in _modules() for name, text in m.ORACLES.items()}
