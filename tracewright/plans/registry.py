"""All registered queries of the core and their SQL, by name."""

from __future__ import annotations

from importlib import import_module

MODULES = ("problems", "intervals", "retrieval", "logs", "formats", "traces")


def _merged(what: str) -> dict:
    found: dict = {}
    for name in MODULES:
        part = getattr(import_module(f"tracewright.plans.{name}"), what)
        clash = found.keys() & part.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        found |= part
    return found


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("SQL")
