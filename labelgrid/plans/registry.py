"""Queries by name, each with the SQL that gives the same rows, or None where SQL cannot express it."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        if name in QUERIES:
            raise ValueError(f"{name} is taken")
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep
