"""Seasonal indicators, for every station and date at once.

Each ``with_*`` function adds columns to a gap-free daily table. Those that look
back use windows partitioned by station (and year); those that compare with
history take a baseline of one row per station, or per station and day of year.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from bloomtide.fixed_values import (
    ANOMALY_MESSAGES, ANOMALY_NORMAL, DATE, HEAT_REACHED, HEAT_REMAINING, HEAT_TARGET,
    INSUFFICIENT, LOW_MAX, OVERLAY_WINDOW, PEAK_BAND, POLLEN, PROGRESS_BANDS, PROGRESS_MESSAGES,
    PROGRESS_PAST_PEAK, SHIFT_MESSAGES, SHIFT_USUAL, STATION, TAXON_A_NAME, TAXON_B_NAME,
    TIE_NAME, TREND_DAYS, WASHOUT_DAYS, WASHOUT_MESSAGES, WASHOUT_REFERENCE, WIND_MESSAGES,
    WIND_REFERENCE,
)
from bloomtide.functions.numeric import (
    capped, degree_days, percent_change, round1, truncate, whole,
)
from bloomtide.operators.filters import doy_window
from bloomtide.operators.history import start_doy
from bloomtide.operators.topk import latest_n
from bloomtide.operators.windows import series_window, with_year, year_window

KEYS = (STATION,)


def banded(value: str, bands: Sequence[tuple[float | None, str]]) -> Column:
    """Text of the first band whose upper bound is above the value."""
    out = None
    for bound, text in bands:
        if bound is None:
            return out.otherwise(text)
        hit = F.col(value) < bound
        out = F.when(hit, text) if out is None else out.when(hit, text)
    return out


def severity(value: str, bounds: Sequence[float]) -> Column:
    """0, 1 or 2: how many of the two ascending bounds are reached."""
    low, high = bounds
    return F.when(F.col(value) < low, 0).when(F.col(value) < high, 1).otherwise(2)


def with_running(
    daily: DataFrame, names: Sequence[str], *, keys: Sequence[str] = KEYS, date: str = DATE,
    max_days: int | None = None,
) -> DataFrame:
    """Add those of the running values in ``names`` the table does not have yet.

    ``rain_recent`` covers the last days, the others the year so far (at most
    ``max_days`` back if given). Values added together share one sort.
    """
    df = with_year(daily, date)
    recent = series_window(df, keys, date).rowsBetween(1 - WASHOUT_DAYS, 0)
    so_far = year_window(keys, date)
    if max_days is not None:
        by_day = Window.partitionBy(*keys, "year").orderBy(F.unix_date(F.col(date)))
        so_far = by_day.rangeBetween(-max_days, 0)
    zero = F.lit(0.0)
    a, b = (F.coalesce(F.col(p), zero) for p in POLLEN)
    running = {
        "rain_recent": F.coalesce(F.sum("precipitation").over(recent), zero),
        "heat_total": F.coalesce(F.sum(degree_days("temperature")).over(so_far), zero),
        "pollen_ytd": F.sum(a + b).over(so_far),
        "peak_ytd": F.max(F.greatest(a, b)).over(so_far),
        "season_start_doy": start_doy(date=date).over(so_far),
    }
    return df.withColumns({n: running[n] for n in names if n not in df.columns})


RUNNING = ("rain_recent", "heat_total", "pollen_ytd", "peak_ytd", "season_start_doy")


def with_dominant_taxon(daily: DataFrame) -> DataFrame:
    """The taxon with the larger count of the day, and that count."""
    a, b = (F.coalesce(F.col(p), F.lit(0.0)) for p in POLLEN)
    name = F.when(a > b, TAXON_A_NAME).when(b > a, TAXON_B_NAME).otherwise(TIE_NAME)
    return daily.withColumns({"dominant": name, "dominant_value": F.greatest(a, b)})


def with_wind_index(daily: DataFrame) -> DataFrame:
    """Wind on a scale of 0 to 10; no wind reading counts as calm."""
    wind = F.coalesce(F.col("wind"), F.lit(0.0))
    index = capped(round1(wind / WIND_REFERENCE * 10), 10.0)
    return daily.withColumn("wind_index", index).withColumn(
        "wind_message", banded("wind_index", WIND_MESSAGES)
    )


def with_washout_score(daily: DataFrame, **running) -> DataFrame:
    """How far the rain of the last three days has cleaned the air, in percent."""
    df = with_running(daily, ["rain_recent"], **running)
    score = capped(truncate(F.col("rain_recent") / WASHOUT_REFERENCE * 100), 100)
    return df.withColumn("washout_score", score).withColumn(
        "washout_message", banded("washout_score", WASHOUT_MESSAGES)
    )


def with_heat_sum(daily: DataFrame, **running) -> DataFrame:
    """Degree days of the year so far against the flowering threshold."""
    df = with_running(daily, ["heat_total"], **running)
    left = F.lit(HEAT_TARGET) - F.col("heat_sum")
    reached = F.col("heat_sum") >= HEAT_TARGET
    return df.withColumn("heat_sum", truncate("heat_total")).withColumns({
        "heat_reached": reached,
        "heat_remaining": F.greatest(left, F.lit(0)),
        "heat_message": F.when(reached, HEAT_REACHED)
        .otherwise(F.concat(left.cast("string"), F.lit(HEAT_REMAINING))),
    })


def with_season_progress(daily: DataFrame, **running) -> DataFrame:
    """Pollen of the year so far as a share of a mean year, in percent.

    Needs ``mean_total`` of the station baseline; without history it is 0.
    """
    df = with_running(daily, ["pollen_ytd"], **running)
    share = capped(truncate(F.col("pollen_ytd") / F.col("mean_total") * 100), 100)
    past_peak = F.col("season_progress") > PROGRESS_PAST_PEAK
    return df.withColumn(
        "season_progress",
        F.when(F.col("mean_total") > 0, share).otherwise(F.lit(0).cast("bigint")),
    ).withColumns({
        "progress_band": severity("season_progress", PROGRESS_BANDS),
        "past_peak": past_peak,
        "progress_message": F.when(past_peak, PROGRESS_MESSAGES[1])
        .otherwise(PROGRESS_MESSAGES[0]),
    })


def with_seasonal_anomaly(daily: DataFrame) -> DataFrame:
    """Deviation from the usual level of this time of year, in percent.

    Needs ``mean_a`` and ``mean_b`` around the day of year. Both taxa count
    equally; one whose usual level is 0 counts as no deviation. Without any
    history around the day the deviation is 0 and the message says so.
    """
    normal, above, below = ANOMALY_MESSAGES
    a, b = (F.coalesce(F.col(p), F.lit(0.0)) for p in POLLEN)
    anomaly = (percent_change(a, F.col("mean_a")) + percent_change(b, F.col("mean_b"))) / 2
    value = F.col("anomaly")

    def around(text: tuple[str, str]) -> Column:
        return F.concat(F.lit(text[0]), whole(value), F.lit(text[1]))

    message = (
        F.when(F.col("mean_a").isNull() & F.col("mean_b").isNull(), INSUFFICIENT)
        .when(F.abs(value) < ANOMALY_NORMAL, normal)
        .when(value > 0, around(above)).otherwise(around(below))
    )
    return daily.withColumn("anomaly", anomaly).withColumn("anomaly_message", message)


def with_phenology_shift(daily: DataFrame, **running) -> DataFrame:
    """Days by which the season started earlier than usual (later: negative).

    Needs ``mean_start`` of the station baseline. Missing until the season of
    the current year has started, or without any historical start.
    """
    df = with_running(daily, ["season_start_doy"], **running)
    early, late, usual = SHIFT_MESSAGES
    shift = F.col("phenology_shift")
    days = F.abs(shift).cast("string")
    message = (
        F.when(shift.isNull(), INSUFFICIENT)
        .when(shift > SHIFT_USUAL, F.concat(days, F.lit(early)))
        .when(shift < -SHIFT_USUAL, F.concat(days, F.lit(late)))
        .otherwise(usual)
    )
    return df.withColumn(
        "phenology_shift", truncate(F.col("mean_start") - F.col("season_start_doy"))
    ).withColumn("shift_message", message)


def with_peak_vs_history(daily: DataFrame, **running) -> DataFrame:
    """Highest count of the year so far against the mean yearly peak, in percent.

    Needs ``mean_peak`` of the station baseline. Band 2 is far above, 0 far below.
    """
    df = with_running(daily, ["peak_ytd"], **running)
    change = F.when(
        F.col("mean_peak") > 0, (F.col("peak_ytd") / F.col("mean_peak") - 1) * 100
    ).otherwise(F.lit(0.0))
    return df.withColumn("peak_change", change).withColumn(
        "peak_band",
        F.when(F.col("peak_change") > PEAK_BAND, 2)
        .when(F.col("peak_change") < -PEAK_BAND, 0).otherwise(1),
    )


def trend(
    daily: DataFrame, *, days: int = TREND_DAYS, keys: Sequence[str] = KEYS, date: str = DATE
) -> DataFrame:
    """The last ``days`` days of both pollens, flagged above the risk threshold."""
    recent = latest_n(daily.select(*keys, date, *POLLEN), days, keys=keys, date=date)
    return recent.withColumns({
        f"{p}_above": F.coalesce(F.col(p) > LOW_MAX, F.lit(False)) for p in POLLEN
    })


def year_overlay(
    history: DataFrame, target: dt.date, *, half_width: int = OVERLAY_WINDOW,
    keys: Sequence[str] = KEYS, date: str = DATE,
) -> DataFrame:
    """Other years around the target's day of year, latest year flagged."""
    near = doy_window(history, target, half_width, date=date, exclude_year=True)
    year = F.year(date)
    latest = F.max("year").over(Window.partitionBy(*keys))
    return (
        near.select(*keys, year.alias("year"), F.dayofyear(date).alias("doy"), *POLLEN)
        .withColumn("is_latest_year", F.col("year") == latest)
        .orderBy(*keys, "year", "doy")
    )
