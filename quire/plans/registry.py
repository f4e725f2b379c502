"""Every registered query with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.sources import views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def add(name: str, query: Query, sql: str | None = None, plain: bool = False) -> None:
    """Registers a query; its SQL may use the derived views unless it is ``plain``, and adds views of its own behind a
    ``+``, or ``+ RECURSIVE`` if one of them reads itself."""
    QUERIES[name] = query
    if sql:
        own = sql.lstrip()
        deep, own = own.startswith("+ RECURSIVE "), own.replace("+ RECURSIVE ", "+ ", 1)
        SQL[name] = sql if plain else f"WITH {'RECURSIVE ' * deep}{views.SQL.strip()}{',' if own.startswith('+') else ''}\n{own.removeprefix('+')}"
