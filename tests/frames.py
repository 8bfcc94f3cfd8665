"""Small hand-made tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from bloomtide.schemas import DAILY, JOINED_HOURLY, POLLEN_HOURLY, WEATHER_HOURLY

D = dt.date
T = dt.datetime


def daily(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """(station, date, pollen_a, pollen_b, temperature, precipitation, wind)."""
    return spark.createDataFrame(rows, DAILY)


def series(spark: SparkSession, first: dt.date, values: dict[str, list], station: int = 1):
    """Consecutive days; columns not given are 0.0."""
    n = len(next(iter(values.values())))
    names = ("pollen_a", "pollen_b", "temperature", "precipitation", "wind")
    return daily(spark, [
        (station, first + dt.timedelta(days=i), *[values.get(c, [0.0] * n)[i] for c in names])
        for i in range(n)
    ])


def pollen(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, POLLEN_HOURLY)


def weather(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, WEATHER_HOURLY)


def joined(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, JOINED_HOURLY)


def column(df: DataFrame, name: str, order: str = "date") -> list:
    return [r[name] for r in df.orderBy(order).collect()]
