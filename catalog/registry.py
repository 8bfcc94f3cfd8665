"""Registers queries together with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

DIGITS = 6


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with its oracle if there is one."""
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


NUDGE = 1e-9


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles to a fixed number of digits: sums depend on the order of addition.

    Means of few readings can fall exactly between two results, where the last
    bit of the sum would decide; the nudge takes them off that point.
    """
    return df.select(*[
        (F.round(F.col(c) + NUDGE, digits) + F.lit(0.0)).alias(c) if kind == "double"
        else F.col(c)
        for c, kind in df.dtypes
    ])


def r(expression: str, name: str | None = None) -> str:
    """The same rounding in SQL."""
    return f"round(({expression}) + {NUDGE}, {DIGITS}) + 0.0 AS {name or expression}"


def rs(*names: str) -> str:
    return ", ".join(r(n) for n in names)
