"""All queries of the core, and their SQL."""

from __future__ import annotations

from .operators import queries_corpus, queries_formats, queries_ranking, queries_skew

_PARTS = [queries_skew, queries_ranking, queries_corpus, queries_formats]


def queries() -> dict:
    return {k: f for part in _PARTS for k, f in part.QUERIES.items()}


def sql() -> dict:
    return {k: s for part in _PARTS for k, s in part.SQL.items()}
