"""The registered queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, **kinds: str) -> Callable[[Query], Query]:
    """Registers a query under its name. kinds: SQL types of columns that the statement leaves otherwise."""
    if sql and kinds:
        casts = ", ".join(f'CAST("{c}" AS {kind}) AS "{c}"' for c, kind in kinds.items())
        sql = f"SELECT * REPLACE ({casts}) FROM ({sql})"

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add
