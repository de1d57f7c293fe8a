"""All queries by name, with the DuckDB statement of each that SQL can express."""

from __future__ import annotations

from . import check_queries, file_queries, floor_queries, store_queries

_MODULES = (store_queries, floor_queries, file_queries, check_queries)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
