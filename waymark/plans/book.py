"""Where query modules put their queries and SQL twins."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a (spark, sf_dir) function under ``name``, with its DuckDB twin."""

    def put(f):
        assert name not in QUERIES, name
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put
