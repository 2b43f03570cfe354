"""Named queries and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from poolsight.session import ship

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

DIGITS = 6
#: Added before rounding, so that values that end in exactly half a digit (means of short
#: segments do) round the same way whatever the order of summation.
NUDGE = 3e-10


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def rounded(df: DataFrame, columns: Sequence[str], digits: int = DIGITS) -> DataFrame:
    """Round to the digits both engines agree on, without negative zeros."""
    return df.withColumns({c: F.round(F.col(c) + NUDGE, digits) + F.lit(0.0) for c in columns})


def r(sql: str, name: str | None = None, digits: int = DIGITS) -> str:
    """The same rounding in SQL."""
    text = f"round({sql} + {NUDGE!r}, {digits}) + 0.0e0"
    return f"{text} as {name}" if name else text
