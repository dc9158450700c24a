"""How a module of ``checks`` registers its queries."""

from __future__ import annotations

from collections.abc import Callable


def registry():
    """Two dictionaries, queries and their SQL, and the decorator that fills them."""
    queries: dict[str, Callable] = {}
    sql: dict[str, str] = {}

    def query(name: str, text: str | None = None):
        def add(fn: Callable) -> Callable:
            queries[name] = fn
            if text is not None:
                sql[name] = text
            return fn

        return add

    return queries, sql, query
