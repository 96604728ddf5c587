"""Query registry: what each operator does on the given tables, and the same in SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("serving", "living", "columns", "extracting", "streams")


def _all(name: str) -> dict:
    return {k: v for m in MODULES for k, v in getattr(import_module(f".{m}", __name__), name).items()}


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("ORACLE")
