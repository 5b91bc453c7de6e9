"""All registered queries of the library and their oracle SQL."""

from __future__ import annotations

import importlib

FAMILIES = ("usage", "metrics", "analytics", "rules", "search", "retrieval", "corpus", "references", "code", "checks", "extras", "quality")


def _families():
    return [importlib.import_module(f"docsense.plans.{name}") for name in FAMILIES]


def queries() -> dict:
    return {name: f for family in _families() for name, f in family.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for family in _families() for name, sql in family.SQL.items()}
