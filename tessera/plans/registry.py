"""Every registered query with its oracle, gathered from the modules of ``tessera.plans``."""

from __future__ import annotations

from collections.abc import Callable

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable:
    """Decorator: ``f(spark, sf_dir) -> DataFrame`` under ``name``, with DuckDB SQL for the same rows."""

    def keep(f: Callable) -> Callable:
        if name in _QUERIES:
            raise ValueError(f"two queries are called {name}")
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return keep


def _load() -> None:
    from tessera.plans import aliasing, components, corpus, evidence, owning, platform, printing, reporting, scanning, sourcing, trees, treescan  # noqa: F401  they register themselves


def queries() -> dict[str, Callable]:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _SQL
