"""All queries of the engine by key, with their SQL twins."""

from __future__ import annotations

from . import evaluation, evidence, ingest, retrieval, scope, storage, streams

_AREAS = (scope, ingest, retrieval, evidence, evaluation, storage, streams)
QUERIES = {k: f for a in _AREAS for k, f in a.query.queries.items()}
ORACLE_SQL = {k: q for a in _AREAS for k, q in a.query.sql.items()}
