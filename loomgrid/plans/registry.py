"""All queries of the core, with their SQL."""

from __future__ import annotations

from loomgrid.plans import data_queries, finding_queries, graph_queries, integrity, pipeline_queries, search_queries

MODULES = (integrity, graph_queries, search_queries, finding_queries, data_queries, pipeline_queries)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
