"""All indicators of a station and date in one row."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from bloomtide.fixed_values import DATE, STATION, WASHOUT_DAYS
from bloomtide.operators.history import keep_years, station_baseline, windowed_mean
from bloomtide.operators.indicators import (
    RUNNING, with_dominant_taxon, with_heat_sum, with_peak_vs_history, with_phenology_shift,
    with_running, with_season_progress, with_seasonal_anomaly, with_washout_score,
    with_wind_index,
)
from bloomtide.operators.lookups import attach_baseline
from bloomtide.operators.topk import row_at_or_last

KEYS = (STATION,)

BULLETIN_COLUMNS = (
    "dominant", "dominant_value", "wind_index", "wind_message", "washout_score",
    "washout_message", "heat_sum", "heat_reached", "heat_remaining", "heat_message",
    "season_progress", "progress_band", "past_peak", "progress_message", "anomaly",
    "anomaly_message", "season_start_doy", "phenology_shift", "shift_message", "peak_ytd",
    "peak_change", "peak_band",
)


def with_baselines(
    daily: DataFrame, history: DataFrame, *, keys: Sequence[str] = KEYS, date: str = DATE,
    wrap: bool = False,
) -> DataFrame:
    """Daily rows with their station's yearly means and day-of-year means.

    The day-of-year means come as one map per station, of at most 366 entries.
    So both joins are on the station alone, with one row per station on the
    other side, and the daily table needs no second partitioning by station and
    day of year: where nothing can be broadcast it is shuffled once, for the
    joins and all windows together.
    """
    yearly = station_baseline(history, keys=keys, date=date)
    around = windowed_mean(history, wrap=wrap, keys=keys, date=date)
    entry = F.struct("doy", F.struct("mean_a", "mean_b"))
    by_station = around.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(entry)).alias("_around")
    )
    joined = attach_baseline(attach_baseline(daily, yearly, keys=keys), by_station, keys=keys)
    usual = F.col("_around")[F.dayofyear(date)]
    return joined.withColumns({
        "mean_a": usual.getField("mean_a"), "mean_b": usual.getField("mean_b")
    }).drop("_around")


def bulletin(
    daily: DataFrame,
    history: DataFrame | None = None,
    *,
    keys: Sequence[str] = KEYS,
    date: str = DATE,
    history_years: tuple[int, int] | None = None,
    max_days: int | None = None,
    wrap: bool = False,
) -> DataFrame:
    """Every indicator for every row of a gap-free daily table.

    ``history`` defaults to the table itself, which is then read three times, so
    hand in a stored table rather than a long plan. ``max_days`` limits how far back
    the year-to-date values look, ``history_years`` which years are compared.
    """
    past = keep_years(daily if history is None else history, history_years, date=date)
    df = with_baselines(daily, past, keys=keys, date=date, wrap=wrap)
    df = with_running(df, RUNNING, keys=keys, date=date, max_days=max_days)
    for add in (
        with_dominant_taxon, with_wind_index, with_washout_score, with_heat_sum,
        with_season_progress, with_seasonal_anomaly, with_phenology_shift, with_peak_vs_history,
    ):
        df = add(df)
    return df.select(*keys, date, *BULLETIN_COLUMNS)


def bulletin_at(
    daily: DataFrame, target: dt.date, history: DataFrame | None = None, *,
    keys: Sequence[str] = KEYS, date: str = DATE, **options,
) -> DataFrame:
    """The bulletin of one date; a station without it gets that of its last day.

    Each station's day is found first, from the keys and dates alone. Of the daily
    table only what these days need is read on: their year so far (a day's values
    count within its own year, also where that is not the target's) and the days
    before it that the recent rain takes.
    """
    exact = F.max(F.when(F.col(date) == F.lit(target), F.col(date)))
    chosen = daily.groupBy(*keys).agg(F.coalesce(exact, F.max(date)).alias("_chosen"))
    start = F.date_sub(F.trunc("_chosen", "year"), WASHOUT_DAYS - 1)
    first, last = chosen.agg(F.min(start), F.max("_chosen")).first()
    past = daily if history is None else history
    in_reach = daily.filter(F.col(date).between(F.lit(first), F.lit(last)))
    needed = in_reach.join(chosen, list(keys)).filter(F.col(date).between(start, F.col("_chosen"))).drop("_chosen")
    rows = bulletin(needed, past, keys=keys, date=date, **options)
    return row_at_or_last(rows, target, keys=keys, date=date)
