"""Registered queries, one module per group of operators."""

from __future__ import annotations

import importlib

from freshet.catalog.registry import ORACLE, QUERIES

MODULES = [
    "projections", "filters", "dedup", "joins", "windows", "grid", "metrics", "sampling",
    "regression", "intervals", "diagnostics", "stats", "quality", "toplists", "sources", "ml",
]

for _m in MODULES:
    importlib.import_module(f"freshet.catalog.{_m}")

__all__ = ["ORACLE", "QUERIES"]
