"""All queries outside the language subpackage, and their SQL."""

from __future__ import annotations

from . import core_problems, fallback_queries, record_queries, relation_queries, sample_queries, scoring_queries, source_queries

FLAGSHIP = "score_by_category"
QUERIES: dict = {}
ORACLE: dict = {}
for part in (core_problems, scoring_queries, record_queries, relation_queries, sample_queries, source_queries, fallback_queries):
    QUERIES |= part.QUERIES
    ORACLE |= part.ORACLE
