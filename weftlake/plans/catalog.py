"""The registry of queries: a name, a callable (spark, sf_dir) -> DataFrame and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from weftlake.sources import adapters

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, base: bool = True):
    """Register a query; sql continues the adapters' common table expressions unless base is False."""

    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            text = sql.strip()
            if base:
                text = adapters.SQL.rstrip() + (", " + text[5:] if text[:5].upper() == "WITH " else "\n" + text)
            ORACLE_SQL[name] = text
        return f

    return add
