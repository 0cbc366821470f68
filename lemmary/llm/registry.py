"""All queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from lemmary.llm import queries_documents as _documents
from lemmary.llm import queries_patterns as _patterns
from lemmary.llm import queries_triple as _triple

_MODULES = (_documents, _patterns, _triple)

QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in _MODULES for k, v in m.ORACLE.items()}
