"""All queries of the subpackage and the SQL that checks them."""

from __future__ import annotations

from . import queries_data, queries_text, queries_vectors

_MODULES = (queries_data, queries_text, queries_vectors)


def queries() -> dict:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for module in _MODULES for name, sql in module.SQL.items()}
