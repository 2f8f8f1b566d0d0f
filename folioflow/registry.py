"""Every query of the library by name, with its DuckDB oracle where there is one."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Register a (spark, sf_dir) -> DataFrame function under a name, with equivalent DuckDB SQL."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def load() -> dict:
    """Import all modules that register queries; the queries by name."""
    for module in ("search", "fusion", "hierarchy", "consolidation", "text", "predicates", "aggregates", "joins", "research", "io", "assisted"):
        importlib.import_module(f"folioflow.plans.{module}")
    return QUERIES
