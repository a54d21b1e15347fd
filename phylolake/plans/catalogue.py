"""All registered queries and their SQL counterparts."""

from __future__ import annotations

from phylolake.plans import annotation_queries, data_queries, file_queries, relation_queries, release_queries, search_queries, similarity_queries, summary_queries

MODULES = (data_queries, relation_queries, annotation_queries, search_queries, similarity_queries, summary_queries, release_queries, file_queries)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLE.items()}
