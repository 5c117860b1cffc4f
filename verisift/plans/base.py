"""Registering queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

#: The SQL twin of ``sources.tables.chunks`` and ``candidates``.
CHUNKS = """chunks AS (SELECT doc_id AS chunk_id, doc_id, 'org' || (doc_id % 3) AS org_id, (['CPG','EMR','LIT','SAFETY'])[doc_id % 4 + 1] AS source_type,
 CASE WHEN doc_id % 4 = 1 THEN 'p' || (doc_id % 10) END AS patient_id, text, lang, source, (['Background','Recommendation','Warning signs','Methods'])[(doc_id // 4) % 4 + 1] AS section,
 (doc_id % 11) / 10.0::DOUBLE AS grade_score, (doc_id % 8) / 8.0::DOUBLE AS reliability, (DATE '2015-01-01' + (doc_id % 3650)::INT)::DATE AS effective_date,
 CASE WHEN doc_id % 9 = 0 THEN 'old' ELSE 'cur' END AS embedding_space, CASE WHEN doc_id % 10 = 0 THEN 32 WHEN doc_id % 23 = 0 THEN 0 ELSE 64 END AS embedding_dim,
 doc_id % 13 = 0 AS obsolete, doc_id % 17 = 0 AS mismatch, doc_id % 19 = 0 AS weak,
 (DATE '2014-06-01' + (doc_id * 7 % 3650)::INT)::DATE AS stamp, CASE WHEN doc_id % 14 = 0 THEN NULL WHEN doc_id % 15 = 0 THEN 'm0' ELSE 'm1' END AS embedding_model,
 CASE WHEN doc_id % 21 = 0 THEN NULL WHEN doc_id % 22 = 0 THEN 0 ELSE 64 END AS embedding_size, [(['cardio','renal','neuro'])[(doc_id // 2) % 3 + 1], 'general'] AS tags,
 (['rct','cohort','systematic review','case report','observational',''])[(doc_id // 3) % 6 + 1] AS design, (['cardio','renal','onco'])[doc_id % 3 + 1] AS specialty FROM documents)"""
CANDIDATES = CHUNKS + """, cand AS (SELECT *, doc_id // 25 AS query_id, (doc_id * 37 % 101) / 100.0::DOUBLE AS rerank, (doc_id * 53 % 97) / 96.0::DOUBLE AS dense,
 CASE WHEN doc_id % 3 <> 0 THEN (doc_id * 29 % 89) / 88.0::DOUBLE END AS lexical, len(regexp_extract_all(text, '\\S+'))::BIGINT AS tokens FROM chunks)"""


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None, base: str = "", name: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            key = name or f.__name__
            if key in self.queries:
                raise KeyError(key)
            self.queries[key] = f
            if sql:
                self.sql[key] = f"WITH {base}{' ' if sql.lstrip().upper().startswith('SELECT') else ', '}{sql}" if base else sql
            return f

        return add
