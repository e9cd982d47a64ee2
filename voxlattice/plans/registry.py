"""All queries of the reference's operators and the SQL that checks them."""

from __future__ import annotations

from . import queries_analysis, queries_evaluate, queries_frames, queries_prepare, queries_signal

_MODULES = (queries_analysis, queries_evaluate, queries_prepare, queries_signal, queries_frames)


def queries() -> dict:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for module in _MODULES for name, sql in module.SQL.items()}
