"""Every query by name, with its SQL and the operators of the inventory that it covers."""

from __future__ import annotations

from importlib import import_module

#: Modules of the catalog, each with a list `Q` of queries.
FAMILIES = ("intervals", "aggregates", "search", "spatial", "graph", "domain", "topology", "areas", "lines", "nearest", "reviewed", "overrides", "noding")


def all_queries() -> list:
    return [q for name in FAMILIES for q in import_module(f"spanwright.catalog.{name}").Q]


def queries() -> dict:
    return {q.name: q.run for q in all_queries()}


def oracle_sql() -> dict:
    return {q.name: q.sql for q in all_queries() if q.sql}


def coverage() -> dict[str, list[str]]:
    """The queries that cover each operator id."""
    out: dict[str, list[str]] = {}
    for q in all_queries():
        for i in q.covers.split():
            out.setdefault(i, []).append(q.name)
    return out
