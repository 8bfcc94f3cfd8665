"""What past years look like: annual totals, peaks, season starts, day-of-year means.

History is reduced to one row per station and year, or per station and day of
year, before anything is compared with it, so no date is joined with all its
historical counterparts.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from bloomtide.fixed_values import ANOMALY_WINDOW, DATE, SEASON_START_LEVEL, STATION
from bloomtide.operators.filters import LEAP_YEAR_LENGTH, year_to_date

KEYS = (STATION,)


def keep_years(history: DataFrame, years: Sequence[int] | None, *, date: str = DATE) -> DataFrame:
    """Restrict history to (first, last) year; None keeps all of it."""
    if years is None:
        return history
    first, last = years
    return history.filter(F.col(date).between(
        F.lit(dt.date(first, 1, 1)), F.lit(dt.date(last, 12, 31))
    ))


def start_doy(pollen: str | Column = "pollen_a", date: str = DATE) -> Column:
    """Aggregate: first day of the year above the season start level."""
    pollen = F.col(pollen) if isinstance(pollen, str) else pollen
    return F.min(F.when(pollen > SEASON_START_LEVEL, F.dayofyear(date)))


def annual_profile(
    history: DataFrame, *, keys: Sequence[str] = KEYS, date: str = DATE
) -> DataFrame:
    """Total, peak per taxon and season start per year."""
    return history.groupBy(*keys, F.year(date).alias("year")).agg(
        (F.coalesce(F.sum("pollen_a"), F.lit(0.0)) + F.coalesce(F.sum("pollen_b"), F.lit(0.0)))
        .alias("total"),
        F.max("pollen_a").alias("peak_a"), F.max("pollen_b").alias("peak_b"),
        start_doy(date=date).alias("start_doy"),
    )


def station_baseline(
    history: DataFrame, *, keys: Sequence[str] = KEYS, date: str = DATE
) -> DataFrame:
    """Means over the years: total, larger of the two peaks, season start."""
    return annual_profile(history, keys=keys, date=date).groupBy(*keys).agg(
        F.avg("total").alias("mean_total"),
        F.greatest(F.avg("peak_a"), F.avg("peak_b")).alias("mean_peak"),
        F.avg("start_doy").alias("mean_start"),
    )


def annual_total_mean(history: DataFrame, *, keys: Sequence[str] = KEYS, date: str = DATE) -> DataFrame:
    return station_baseline(history, keys=keys, date=date).select(*keys, "mean_total")


def annual_peak_mean(history: DataFrame, *, keys: Sequence[str] = KEYS, date: str = DATE) -> DataFrame:
    return annual_profile(history, keys=keys, date=date).groupBy(*keys).agg(
        F.avg("peak_a").alias("mean_peak_a"), F.avg("peak_b").alias("mean_peak_b"),
        F.greatest(F.avg("peak_a"), F.avg("peak_b")).alias("mean_peak"),
    )


def season_start(history: DataFrame, *, keys: Sequence[str] = KEYS, date: str = DATE) -> DataFrame:
    """Season start per year; missing for a year that never exceeds the level."""
    return annual_profile(history, keys=keys, date=date).select(*keys, "year", "start_doy")


def season_start_mean(history: DataFrame, *, keys: Sequence[str] = KEYS, date: str = DATE) -> DataFrame:
    return season_start(history, keys=keys, date=date).groupBy(*keys).agg(
        F.avg("start_doy").alias("mean_start")
    )


def windowed_mean(
    history: DataFrame, *, half_width: int = ANOMALY_WINDOW, wrap: bool = False,
    keys: Sequence[str] = KEYS, date: str = DATE,
) -> DataFrame:
    """Mean of each taxon around every day of the year, over all years.

    History first shrinks to sums per station and day of year (at most 366);
    each of these then counts towards the days within ``half_width`` of it.
    """
    per_day = history.groupBy(*keys, F.dayofyear(date).alias("_d")).agg(
        F.sum("pollen_a").alias("_sa"), F.count("pollen_a").alias("_na"),
        F.sum("pollen_b").alias("_sb"), F.count("pollen_b").alias("_nb"),
    )
    day, last = F.col("_d"), F.lit(LEAP_YEAR_LENGTH)
    if wrap:
        near = F.explode(F.sequence(day - half_width, day + half_width))
        near_days = per_day.withColumn("_n", near).withColumn(
            "doy", F.pmod(F.col("_n") - 1, last) + 1
        )
    else:
        near = F.sequence(F.greatest(day - half_width, F.lit(1)), F.least(day + half_width, last))
        near_days = per_day.withColumn("doy", F.explode(near))

    def mean(total: str, n: str) -> Column:
        return F.when(F.sum(n) > 0, F.sum(total) / F.sum(n))

    return near_days.groupBy(*keys, "doy").agg(
        mean("_sa", "_na").alias("mean_a"), mean("_sb", "_nb").alias("mean_b")
    )


def year_to_date_totals(
    daily: DataFrame, target: dt.date, *, keys: Sequence[str] = KEYS, date: str = DATE
) -> DataFrame:
    """Sum and maximum of both pollens since 1 January."""
    return year_to_date(daily, target, date=date).groupBy(*keys).agg(
        (F.sum("pollen_a") + F.sum("pollen_b")).alias("total"),
        F.greatest(F.max("pollen_a"), F.max("pollen_b")).alias("peak"),
    )
