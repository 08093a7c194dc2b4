"""A register of queries and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Book:
    def __init__(self) -> None:
        self._queries: dict[str, Query] = {}
        self._sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        """Register the decorated function under its name, with its SQL if there is one."""

        def keep(f: Query) -> Query:
            self._queries[f.__name__] = f
            if sql:
                self._sql[f.__name__] = sql
            return f

        return keep

    def queries(self) -> dict[str, Query]:
        return dict(self._queries)

    def oracle_sql(self) -> dict[str, str]:
        return dict(self._sql)
