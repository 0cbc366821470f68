"""All core queries and the SQL that checks them."""

from __future__ import annotations

from lemmary.plans import loading, sentence_queries, store_queries

_MODULES = (loading, store_queries, sentence_queries)

QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in _MODULES for k, v in m.ORACLE.items()}
