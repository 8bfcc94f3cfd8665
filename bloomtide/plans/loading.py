"""From stored or landed feeds to the tables the other plans take."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from bloomtide.fixed_values import BULLETIN_DAYS, STATION, TS
from bloomtide.operators.daily import daily_pollen_history, daily_table
from bloomtide.sources.chain import Reader, read_first_available
from bloomtide.sources.scans import canonicalize, trailing_window_scan

KEYS = (STATION,)


def daily_for_date(
    pollen: DataFrame, weather: DataFrame, target: dt.date, *, days: int = BULLETIN_DAYS,
    keys: tuple[str, ...] = KEYS, ts: str = TS,
) -> DataFrame:
    """Gap-free daily table of the ``days`` before a date, from two hourly feeds.

    The date bound is put on both feeds before they are joined, so that only
    these days are read.
    """
    return daily_table(
        trailing_window_scan(canonicalize(pollen), target, days, ts=ts),
        trailing_window_scan(canonicalize(weather), target, days, ts=ts),
        keys=keys, ts=ts,
    )


def pollen_history(
    spark: SparkSession, sources: Sequence[tuple[str, Reader]], *, cache_path: str,
    force_reload: bool = False, keys: tuple[str, ...] = KEYS,
) -> DataFrame:
    """Daily pollen of all years, from the first hourly source that can be read.

    What is cached is the daily table, which is far smaller than its source.
    """
    def as_days(reader: Reader) -> Reader:
        return lambda s: daily_pollen_history(canonicalize(reader(s)), keys=keys)

    return read_first_available(
        spark, [(name, as_days(reader)) for name, reader in sources],
        cache_path=cache_path, force_reload=force_reload,
    )
