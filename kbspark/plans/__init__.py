"""Registered queries with their SQL, and the mapping of the given tables to the model."""

from __future__ import annotations


def registered() -> tuple[dict, dict[str, str]]:
    from kbspark.plans import queries

    return dict(queries.QUERIES), dict(queries.ORACLE_SQL)
