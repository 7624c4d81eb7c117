"""All registered queries outside the ``llm`` subpackage."""

from __future__ import annotations

from . import ref_queries, store_queries, sync_queries, tree_queries

QUERIES = store_queries.QUERIES | tree_queries.QUERIES | ref_queries.QUERIES | sync_queries.QUERIES
SQL = store_queries.SQL | tree_queries.SQL | ref_queries.SQL | sync_queries.SQL
