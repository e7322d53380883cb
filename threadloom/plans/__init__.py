"""Queries on the given tables. Importing a module registers its queries."""

from __future__ import annotations

import importlib

from threadloom.plans.base import QUERIES, Query

MODULES = (
    "sources extraction filters relations aggregates ranking search documents cells evaluation telemetry streams surface"
).split()


def catalogue() -> dict[str, Query]:
    for module in MODULES:
        importlib.import_module(f"threadloom.plans.{module}")
    return QUERIES
