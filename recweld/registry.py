"""All linkage queries: name -> callable, name -> DuckDB SQL."""

from __future__ import annotations

from .plans import blocking_queries, decision_queries, feature_queries, learning_queries, relational_queries  # noqa: F401
from .plans.base import QUERIES, SQL


def queries():
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
