"""All registered queries of the library and their DuckDB counterparts."""

from __future__ import annotations

from . import diagnostic_queries, exploratory_queries, governance_queries, identity_queries, master_queries, rule_queries, source_queries, text_queries

FLAGSHIP = "AGG-02"

_MODULES = (rule_queries, governance_queries, diagnostic_queries, text_queries, exploratory_queries, identity_queries, master_queries, source_queries)


def queries() -> dict:
    return {name: run for m in _MODULES for name, (run, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, (_, sql) in m.QUERIES.items() if sql}
