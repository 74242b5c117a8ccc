"""The registered graph queries and the DuckDB SQL of each."""

from __future__ import annotations

from weftgraph.plans import graph_queries, text_queries


def queries():
    return graph_queries.queries() | text_queries.queries()


def oracle_sql():
    return graph_queries.oracle_sql() | text_queries.oracle_sql()
