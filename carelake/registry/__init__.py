"""Registered queries: each pairs a DataFrame query with the same result in plain SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}

_MODULES = ("facilities", "feeds", "drugs", "knowledge", "chat", "logs")


def query(name: str, sql: str | None = None):
    """Register ``f(spark, sf_dir)`` under ``name`` with its SQL, where SQL can say it."""
    def keep(f):
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f
    return keep


def load() -> None:
    for module in _MODULES:
        import_module(f"{__name__}.{module}")
