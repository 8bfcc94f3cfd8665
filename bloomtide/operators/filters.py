"""Row filters on dates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from bloomtide.fixed_values import DATE, TS

LEAP_YEAR_LENGTH = 366


def filter_after(df: DataFrame, instant: str, *, ts: str = TS) -> DataFrame:
    """Rows strictly after an instant."""
    return df.filter(F.col(ts) > F.lit(instant).cast("timestamp_ntz"))


def doy_distance(doy: Column, target: Column | int, wrap: bool = False) -> Column:
    """Days between two positions in the year, optionally across its end."""
    gap = F.abs(doy - target)
    return F.least(gap, LEAP_YEAR_LENGTH - gap) if wrap else gap


def doy_window(
    df: DataFrame, target: dt.date, half_width: int, *,
    date: str = DATE, exclude_year: bool = False, wrap: bool = False,
) -> DataFrame:
    """Rows whose day of year is within ``half_width`` of the target's.

    By default the window ends at the turn of the year.
    """
    position = target.timetuple().tm_yday
    near = doy_distance(F.dayofyear(date), F.lit(position), wrap) <= half_width
    if exclude_year:
        near = near & (F.year(date) != target.year)
    return df.filter(near)


def year_to_date(df: DataFrame, target: dt.date, *, date: str = DATE) -> DataFrame:
    """Rows from 1 January of the target's year up to the target."""
    return df.filter(F.col(date).between(F.lit(dt.date(target.year, 1, 1)), F.lit(target)))
