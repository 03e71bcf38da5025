"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib

MODULES = ("lookalike", "reports", "near", "neighbours", "consensus", "bpe", "sentences", "leaks")


def _merged(name: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(importlib.import_module(f"siftwork.llm.{m}"), name, {})
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("SQL")
