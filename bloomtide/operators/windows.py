"""Lags, rolling and cumulative values over a gap-free daily table.

Row frames are day frames because the calendar has no gaps. A daily table has
one row per key and day, so one key's window partition is bounded by the length
of its calendar (a century is 36,525 rows) however much raw data went in. Series
without that bound are cut into months (:mod:`bloomtide.operators.gaps`).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from bloomtide.fixed_values import DATE, STATION
from bloomtide.functions.numeric import degree_days

KEYS = (STATION,)


def series_window(df: DataFrame, keys: Sequence[str] = KEYS, date: str = DATE) -> WindowSpec:
    """A key's rows in order of date.

    With the ``year`` of the date among the columns the rows are ordered by
    (year, date), which is the same order: windows per key and windows per key
    and year then need the same sort, and the table is sorted once for all.
    """
    order = ["year", date] if "year" in df.columns else [date]
    return Window.partitionBy(*keys).orderBy(*order)


def with_year(df: DataFrame, date: str = DATE) -> DataFrame:
    return df if "year" in df.columns else df.withColumn("year", F.year(date))


def year_window(keys: Sequence[str] = KEYS, date: str = DATE) -> WindowSpec:
    """From 1 January to the current row, for tables with a ``year``."""
    w = Window.partitionBy(*keys, "year").orderBy(date)
    return w.rowsBetween(Window.unboundedPreceding, 0)


def lags(
    df: DataFrame, spec: Mapping[str, tuple[str, int]], *,
    keys: Sequence[str] = KEYS, date: str = DATE,
) -> DataFrame:
    """Earlier values: ``{output: (column, days back)}``."""
    w = series_window(df, keys, date)
    return df.withColumns({out: F.lag(c, k).over(w) for out, (c, k) in spec.items()})


def lead_target(
    df: DataFrame, spec: Mapping[str, str], *, keys: Sequence[str] = KEYS, date: str = DATE
) -> DataFrame:
    """The next day's value: ``{output: column}``; missing on the last day."""
    w = series_window(df, keys, date)
    return df.withColumns({out: F.lead(c, 1).over(w) for out, c in spec.items()})


def _complete(agg: Column, column: str, frame: WindowSpec, n: int) -> Column:
    """``agg`` only where all ``n`` values of the frame are present."""
    return F.when(F.count(column).over(frame) == n, agg.over(frame))


def trailing(column: str, n: int, how: str, frame: WindowSpec) -> Column:
    agg = {"mean": F.avg, "sum": F.sum}[how](column)
    return _complete(agg, column, frame, n)


def rolling_prev(
    df: DataFrame, spec: Mapping[str, tuple[str, int, str]], *,
    keys: Sequence[str] = KEYS, date: str = DATE,
) -> DataFrame:
    """Mean or sum of the ``n`` days before the current one.

    ``{output: (column, n, "mean" | "sum")}``; missing unless all n are there.
    """
    w = series_window(df, keys, date)
    return df.withColumns({
        out: trailing(c, n, how, w.rowsBetween(-n, -1)) for out, (c, n, how) in spec.items()
    })


def rolling_incl(
    df: DataFrame, spec: Mapping[str, tuple[str, int, str]], *,
    keys: Sequence[str] = KEYS, date: str = DATE,
) -> DataFrame:
    """Like :func:`rolling_prev`, over ``n`` days ending with the current one."""
    w = series_window(df, keys, date)
    return df.withColumns({
        out: trailing(c, n, how, w.rowsBetween(1 - n, 0)) for out, (c, n, how) in spec.items()
    })


def _running(column: Column, frame: WindowSpec) -> Column:
    """Running total that skips missing values but is missing on their rows."""
    return F.when(column.isNotNull(), F.sum(column).over(frame))


def gdd_by_year(
    df: DataFrame, *, keys: Sequence[str] = KEYS, date: str = DATE,
    temperature: str = "temperature",
) -> DataFrame:
    """Degree days and their total since 1 January."""
    df = with_year(df, date).withColumn("gdd_daily", degree_days(temperature))
    return df.withColumn("gdd_cumul", _running(F.col("gdd_daily"), year_window(keys, date)))


def gdd_running(
    df: DataFrame, *, keys: Sequence[str] = KEYS, date: str = DATE,
    temperature: str = "temperature",
) -> DataFrame:
    """Degree days and their total since the first row of the key."""
    w = series_window(df, keys, date).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("gdd_daily", degree_days(temperature))
    return df.withColumn("gdd_cumul", _running(F.col("gdd_daily"), w))
