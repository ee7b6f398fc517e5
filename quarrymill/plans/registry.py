"""The registered queries of the core, with their SQL."""

from __future__ import annotations

from quarrymill.plans import evaluation, indexing, memory, retrieval, streams

_PARTS = (retrieval, indexing, memory, evaluation, streams)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
SQL = {name: sql for part in _PARTS for name, sql in part.SQL.items()}
