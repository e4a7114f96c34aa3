"""The queries of this subpackage and the SQL they are compared with."""

from __future__ import annotations

from siltbed.llm import garble_queries, langid_queries, leaks_queries, mixing_queries, pii_queries, toxicity_queries

_MODULES = [garble_queries, langid_queries, leaks_queries, mixing_queries, pii_queries, toxicity_queries]


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.queries().items()}


def oracle_sql() -> dict:
    return {name: sql for m in _MODULES for name, sql in getattr(m, "oracle_sql", dict)().items()}
