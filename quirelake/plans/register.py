"""Where queries and their DuckDB SQL are registered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, days: tuple[str, ...] = ()):
    """Register a query with its oracle; columns in `days` are dates, which both sides give as text."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, sf_dir).withColumns({c: F.col(c).cast("string") for c in days})

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            texts = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in days)
            ORACLE_SQL[f.__name__] = f"SELECT * REPLACE ({texts}) FROM ({sql})" if days else sql
        return run

    return add
