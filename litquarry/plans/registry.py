"""Registered queries and their SQL counterparts."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
FLAGSHIP = "str20_search_score"


def query(name: str, sql: str | None = None):
    """Register a ``(spark, sf_dir) -> DataFrame`` callable, with its SQL where SQL can express it."""

    def wrap(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return wrap


def load() -> None:
    """Import the modules that register queries."""
    from litquarry.plans import q_content, q_functions, q_library, q_more, q_readings, q_relations, q_states  # noqa: F401


