"""From two hourly feeds to one gap-free daily table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from bloomtide.fixed_values import DATE, POLLEN, STATION, TS
from bloomtide.functions.calendar import calendar_parts
from bloomtide.operators.cleaning import fill_constant

KEYS = (STATION,)


def join_hourly(
    pollen: DataFrame, weather: DataFrame, *, keys: tuple[str, ...] = KEYS, ts: str = TS
) -> DataFrame:
    """Hours both feeds have. Rows without a key or time never match."""
    return pollen.join(weather, [*keys, ts], "inner")


def daily_aggregate(hourly: DataFrame, *, keys: tuple[str, ...] = KEYS, ts: str = TS) -> DataFrame:
    """Per day: largest pollen counts, mean temperature and wind, total rain.

    Rain of a day whose readings are all missing is 0. The grouping key is
    (station, day) with partial aggregation before the shuffle, so a station
    with very many readings spreads over its days.
    """
    return hourly.groupBy(*keys, F.to_date(ts).alias(DATE)).agg(
        F.max("pollen_a").alias("pollen_a"),
        F.max("pollen_b").alias("pollen_b"),
        F.avg("temperature").alias("temperature"),
        F.coalesce(F.sum("precipitation"), F.lit(0.0)).alias("precipitation"),
        F.avg("wind").alias("wind"),
    )


def daily_calendar(
    days: DataFrame,
    *,
    keys: tuple[str, ...] = KEYS,
    date: str = DATE,
    zero: tuple[str, ...] = (*POLLEN, "precipitation"),
) -> DataFrame:
    """Every day from the first to the last one of each key.

    An inserted day has 0 in the ``zero`` columns and is missing elsewhere; a
    missing value of ``zero`` columns on an existing day becomes 0 too. Each
    row emits itself and the days up to its successor, so the table is read
    once and nothing is joined. The input has one row per key and day, which
    bounds the window of a key by the length of its calendar.
    """
    w = Window.partitionBy(*keys).orderBy(date)
    values = [c for c in days.columns if c not in (*keys, date)]
    last = F.coalesce(F.date_sub(F.lead(date).over(w), 1), F.col(date))
    spread = days.withColumn("_last", last).withColumn(
        "_day", F.explode(F.sequence(F.col(date), F.col("_last")))
    )
    own = F.col("_day") == F.col(date)
    out = spread.select(
        *keys, F.col("_day").alias(date), *[F.when(own, F.col(v)).alias(v) for v in values]
    )
    return fill_constant(out, [z for z in zero if z in values], 0.0)


def daily_table(
    pollen: DataFrame, weather: DataFrame, *, keys: tuple[str, ...] = KEYS, ts: str = TS
) -> DataFrame:
    """Join, aggregate, fill the calendar: the table all features start from."""
    joined = join_hourly(pollen, weather, keys=keys, ts=ts)
    return daily_calendar(daily_aggregate(joined, keys=keys, ts=ts), keys=keys)


def daily_pollen_history(
    pollen: DataFrame, *, keys: tuple[str, ...] = KEYS, ts: str = TS
) -> DataFrame:
    """Daily pollen maxima over a gap-free calendar, with year and day of year."""
    days = pollen.groupBy(*keys, F.to_date(ts).alias(DATE)).agg(
        *[F.max(p).alias(p) for p in POLLEN]
    )
    return with_history_parts(daily_calendar(days, keys=keys))


def with_history_parts(days: DataFrame, *, date: str = DATE) -> DataFrame:
    parts = calendar_parts(date)
    return days.withColumns({"year": parts["year"], "doy": parts["doy"]})


def archive_plus_forecast(
    archive: DataFrame, forecast: DataFrame, *, keys: tuple[str, ...] = KEYS, date: str = DATE
) -> DataFrame:
    """Archive days followed by forecast days, each with its ``origin``.

    Where both have a day the archive row stays. One row per key, day and
    origin comes in, so the aggregate keeps the better of at most two.
    """
    both = archive.withColumn("origin", F.lit("archive")).unionByName(
        forecast.withColumn("origin", F.lit("forecast"))
    )
    values = [c for c in both.columns if c not in (*keys, date)]
    best = F.min_by(F.struct(*values), F.col("origin"))  # "archive" < "forecast"
    return both.groupBy(*keys, date).agg(best.alias("_b")).select(
        *keys, date, *[F.col("_b").getField(v).alias(v) for v in values]
    )
