"""Every query by name, with the SQL that gives the same rows."""

from __future__ import annotations

from . import label_queries, order_queries, scalar_queries, volume_queries  # noqa: F401
from .registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
