"""All queries and their SQL."""

from __future__ import annotations

from fieldloom.plans import document_queries, license_queries, more_queries

MODULES = (license_queries, document_queries, more_queries)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}
