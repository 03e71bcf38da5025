"""All queries of the core and their SQL."""

from __future__ import annotations

import importlib

MODULES: tuple[str, ...] = ("records", "clusters", "evaluation", "review", "packed")


def _merged(name: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(importlib.import_module(f"siftwork.plans.{m}"), name, {})
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("SQL")
