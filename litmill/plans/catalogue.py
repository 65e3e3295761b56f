"""All core queries with their SQL, gathered from the plan modules."""

from __future__ import annotations

from importlib import import_module

MODULES = ["moments", "records", "analytics", "retrieval", "state", "results", "operations"]


def core_queries() -> dict:
    out: dict = {}
    for name in MODULES:
        out |= import_module(f"litmill.plans.{name}").QUERIES
    return out


def core_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for name in MODULES:
        out |= import_module(f"litmill.plans.{name}").SQL
    return out
