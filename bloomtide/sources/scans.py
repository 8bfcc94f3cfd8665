"""Renaming and date-bounded scans."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from bloomtide.fixed_values import SOURCE_NAMES, TS
from bloomtide.sources.feed import DAY


def canonicalize(df: DataFrame, names: dict[str, str] = SOURCE_NAMES) -> DataFrame:
    """Source column names to canonical ones; others are kept."""
    return df.withColumnsRenamed(names)


def _between(df: DataFrame, column: str, first: dt.date, last: dt.date) -> DataFrame:
    # A half-open range on the bare column: pushed into the Parquet scan for a
    # timestamp as well as for a date (a cast column would not be pushed).
    end = last + dt.timedelta(days=1)
    if df.schema[column].dataType.typeName() == "date":
        low, high = F.lit(first), F.lit(end)
    else:
        low, high = _midnight(first), _midnight(end)
    rows = df.filter((F.col(column) >= low) & (F.col(column) < high))
    if column != DAY and DAY in df.columns:  # a feed stored by day: only the folders of these days are listed
        rows = rows.filter((F.col(DAY) >= F.lit(first)) & (F.col(DAY) <= F.lit(last)))
    return rows


def _midnight(day: dt.date) -> Column:
    return F.lit(f"{day.isoformat()} 00:00:00").cast("timestamp_ntz")


def trailing_window_scan(df: DataFrame, target: dt.date, days: int, *, ts: str = TS) -> DataFrame:
    """Rows dated from ``target - days`` to ``target``, both included."""
    return _between(df, ts, target - dt.timedelta(days=days), target)


def horizon_scan(df: DataFrame, today: dt.date, horizon: int, *, ts: str = TS) -> DataFrame:
    """Rows dated from the day after ``today`` to ``today + horizon``."""
    return _between(df, ts, today + dt.timedelta(days=1), today + dt.timedelta(days=horizon))
