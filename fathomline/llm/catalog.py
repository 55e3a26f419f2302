"""All queries of this subpackage, and their SQL."""

from __future__ import annotations

from . import queries_groups, queries_names, queries_text, queries_vectors

_PARTS = [queries_names, queries_groups, queries_text, queries_vectors]


def queries() -> dict:
    return {k: f for part in _PARTS for k, f in part.QUERIES.items()}


def sql() -> dict:
    return {k: s for part in _PARTS for k, s in part.SQL.items()}
