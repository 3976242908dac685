"""Registry of queries: a Spark function over the driver's tables, and the same result in SQL where SQL has it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isohyet.sources.adapter import panel_sql

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to a fixed number of places (and no negative zero), as engines sum in different orders."""
    return df.select(*[(F.round(F.col(c), places) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(sql: str | None = None, name: str | None = None, last: int | None = None):
    """Register a query; ``sql`` may use the tables obs and panel when ``last`` (the last historical year) is given."""

    def register(f):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql is not None:
            body = sql.strip()
            if last is not None:
                body = f"WITH {panel_sql(last)}" + (f",\n{body[5:]}" if body[:5].upper() == "WITH " else f"\n{body}")
            SQL[key] = body
        return f

    return register
