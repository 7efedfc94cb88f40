"""All queries of the library with their DuckDB twins."""

from __future__ import annotations

from importlib import import_module

MODULES = ("packets", "encoding", "tenancy", "evidence", "replay", "shaping", "forms")


def _all() -> dict:
    out: dict = {}
    for name in MODULES:
        out |= import_module(f"{__package__}.{name}").QUERIES
    return out


def queries() -> dict:
    return {name: run for name, (run, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
