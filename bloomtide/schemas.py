"""Explicit schemas of every table read from files."""

from __future__ import annotations

from pyspark.sql import types as T

from bloomtide.fixed_values import DATE, POLLEN, STATION, TS, WEATHER


def payload_schema(variables: tuple[str, ...], station_type: T.DataType | None = None) -> T.StructType:
    """One landed payload: a station and parallel arrays under ``hourly``."""
    arrays = [T.StructField("time", T.ArrayType(T.StringType()))]
    arrays += [T.StructField(v, T.ArrayType(T.DoubleType())) for v in variables]
    return T.StructType([
        T.StructField(STATION, station_type or T.LongType()),
        T.StructField("hourly", T.StructType(arrays)),
    ])


POLLEN_PAYLOAD = payload_schema(("birch_pollen", "grass_pollen"))
WEATHER_PAYLOAD = payload_schema(("temperature_2m", "precipitation", "wind_speed_10m"))


def _table(time_column: str, time_type: T.DataType, measures: tuple[str, ...]) -> T.StructType:
    fields = [T.StructField(STATION, T.LongType()), T.StructField(time_column, time_type)]
    fields += [T.StructField(m, T.DoubleType()) for m in measures]
    return T.StructType(fields)


POLLEN_HOURLY = _table(TS, T.TimestampNTZType(), POLLEN)
WEATHER_HOURLY = _table(TS, T.TimestampNTZType(), WEATHER)
JOINED_HOURLY = _table(TS, T.TimestampNTZType(), POLLEN + WEATHER)
DAILY = _table(DATE, T.DateType(), POLLEN + WEATHER)
