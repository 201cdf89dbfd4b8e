"""All queries over the tables of a folder, with the SQL of each."""

from __future__ import annotations

from lexgrain.plans import pipeline_queries, retrieval_queries, store_queries, text_queries

MODULES = [text_queries, store_queries, retrieval_queries, pipeline_queries]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
