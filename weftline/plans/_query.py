"""Registration of queries with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.runtime import table

Run = Callable[[SparkSession, str], DataFrame]


class Book:
    """Queries of one module and their statements."""

    def __init__(self) -> None:
        self.queries: dict[str, Run] = {}
        self.statements: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        """Registers a function of a table opener; ``sql`` is DuckDB's statement of the result."""

        def register(f):
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return f(lambda t: table(spark, sf_dir, t))

            run.__name__, run.__doc__ = name, f.__doc__
            self.queries[name] = run
            if sql:
                self.statements[name] = sql
            return f

        return register
