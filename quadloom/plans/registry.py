"""All core queries and their SQL by name."""

from __future__ import annotations

import importlib

MODULES = ("training", "trace", "quadtree", "matrices", "matching", "geometry", "quality", "inputs")


def _modules():
    return [importlib.import_module(f"quadloom.plans.{m}") for m in MODULES]


def queries() -> dict:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _modules() for k, s in m.SQL.items()}
