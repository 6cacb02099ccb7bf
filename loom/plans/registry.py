"""Registered queries: name -> (function of (spark, sf_dir), DuckDB SQL or None)."""

from __future__ import annotations

from importlib import import_module

_FOUND: dict[str, tuple] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers the decorated function under its own name, with the SQL that gives the same rows."""

    def held(f):
        _FOUND[name or f.__name__] = (f, sql)
        return f

    return held


#: Modules of this package whose queries are registered.
MODULES = ["vector_queries", "label_queries", "scalar_queries", "stat_queries", "matrix_queries"]


def _all() -> dict[str, tuple]:
    for name in MODULES:
        import_module(f"loom.plans.{name}")
    return _FOUND


def queries() -> dict:
    return {k: f for k, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _all().items() if sql}
