"""Shared inputs of the queries, once as DataFrames and once as SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from bloomtide.operators.daily import daily_calendar, daily_table
from bloomtide.schemas import DAILY
from bloomtide.session import scratch_path
from bloomtide.sources import fixtures
from bloomtide.sources.files import write_table

TARGET = dt.date(2001, 4, 15)
HOURLY_TARGET = dt.date(2024, 1, 28)
LAST_TRAIN_YEAR = 1999

pollen = fixtures.pollen_hourly
weather = fixtures.weather_hourly


def hourly_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gap-free daily table from the hourly feeds (30 days)."""
    return daily_table(pollen(spark, sf_dir), weather(spark, sf_dir))


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gap-free daily table over several years."""
    return daily_calendar(fixtures.daily(spark, sf_dir))


def stored_table(spark: SparkSession, table: DataFrame, name: str) -> DataFrame:
    """A table written once and read back, for queries that read it repeatedly."""
    path = scratch_path(spark, name)
    write_table(table, path)
    return spark.read.schema(table.schema).parquet(path)


def stored_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table written once and read back, for queries that read it repeatedly."""
    return stored_table(spark, days(spark, sf_dir), "days")


def seasonal_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored daily table with learnable seasons, for fitted models."""
    return stored_table(spark, daily_calendar(fixtures.daily_seasonal(spark, sf_dir)), "seasons")


FEEDS = """
pollen_hourly AS (
  SELECT user_id % 4 AS station, date_trunc('hour', ts) AS ts,
         max(CASE WHEN event_type = 'click' THEN value END) AS pollen_a,
         max(CASE WHEN event_type = 'view' THEN value END) AS pollen_b
  FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2),
weather_hourly AS (
  SELECT user_id % 4 AS station, date_trunc('hour', ts) AS ts,
         avg(CASE WHEN event_type = 'purchase' THEN value END) AS temperature,
         sum(CASE WHEN event_type = 'error' THEN value END) AS precipitation,
         avg(CASE WHEN event_type = 'signup' THEN value END) AS wind
  FROM events WHERE event_type IN ('purchase', 'error', 'signup') GROUP BY 1, 2),
joined AS (
  SELECT p.station, p.ts, p.pollen_a, p.pollen_b, w.temperature, w.precipitation, w.wind
  FROM pollen_hourly p JOIN weather_hourly w ON p.station = w.station AND p.ts = w.ts)
"""

HOURLY_DAILY = FEEDS + """,
daily AS (
  SELECT station, CAST(ts AS DATE) AS date, max(pollen_a) AS pollen_a, max(pollen_b) AS pollen_b,
         avg(temperature) AS temperature, coalesce(sum(precipitation), 0) AS precipitation,
         avg(wind) AS wind
  FROM joined GROUP BY 1, 2)
"""

LONG_DAILY = """
daily AS (
  SELECT l_suppkey % 5 AS station, CAST(l_shipdate AS DATE) AS date,
         coalesce(max(CASE WHEN l_returnflag = 'R' THEN l_quantity END), 0) AS pollen_a,
         coalesce(max(CASE WHEN l_returnflag = 'A' THEN l_extendedprice / 1000 END), 0) AS pollen_b,
         avg(l_quantity) / 2 AS temperature, sum(l_tax) * 10 AS precipitation,
         avg(l_extendedprice) / 1999 AS wind
  FROM lineitem GROUP BY 1, 2)
"""

CALENDAR = """,
span AS (SELECT station, min(date) AS lo, max(date) AS hi FROM daily GROUP BY station),
cal AS (
  SELECT station, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP),
         INTERVAL 1 DAY)) AS DATE) AS date FROM span),
days AS (
  SELECT c.station, c.date, coalesce(d.pollen_a, 0) AS pollen_a,
         coalesce(d.pollen_b, 0) AS pollen_b, d.temperature,
         coalesce(d.precipitation, 0) AS precipitation, d.wind
  FROM cal c LEFT JOIN daily d ON c.station = d.station AND c.date = d.date)
"""

HOURLY_DAYS = HOURLY_DAILY + CALENDAR
LONG_DAYS = LONG_DAILY + CALENDAR

PARTS = """,
parts AS (
  SELECT *, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month,
         CAST(dayofyear(date) AS INTEGER) AS doy FROM days)
"""


def _pollen_lags(p: str) -> str:
    lags = ", ".join(f"lag({p}, {k}) OVER w AS {p}_lag{k}" for k in (1, 2, 3))
    return f"""{lags},
         CASE WHEN count({p}) OVER w3 = 3 THEN avg({p}) OVER w3 END AS {p}_mean3"""


FEATURES = LONG_DAYS + PARTS + f""",
heat AS (
  SELECT *, CASE WHEN temperature > 5 THEN temperature - 5
                 WHEN temperature IS NOT NULL THEN 0.0 END AS gdd_daily FROM parts),
features AS (
  SELECT *,
         CASE WHEN month IN (12, 1, 2) THEN 0 WHEN month <= 5 THEN 1
              WHEN month <= 8 THEN 2 ELSE 3 END AS season,
         sin(2 * pi() * doy / 365) AS doy_sin, cos(2 * pi() * doy / 365) AS doy_cos,
         sin(2 * pi() * month / 12) AS month_sin, cos(2 * pi() * month / 12) AS month_cos,
         lag(temperature, 1) OVER w AS temp_lag1,
         CASE WHEN count(temperature) OVER w7 = 7 THEN avg(temperature) OVER w7 END AS temp_roll7,
         lag(precipitation, 1) OVER w AS precip_lag1, lag(precipitation, 2) OVER w AS precip_lag2,
         CASE WHEN count(precipitation) OVER w7 = 7
              THEN sum(precipitation) OVER w7 END AS precip_roll7,
         lag(wind, 1) OVER w AS wind_lag1,
         CASE WHEN count(wind) OVER w7 = 7 THEN avg(wind) OVER w7 END AS wind_roll7,
         {_pollen_lags("pollen_a")},
         {_pollen_lags("pollen_b")},
         CASE WHEN gdd_daily IS NOT NULL THEN sum(gdd_daily) OVER wy END AS gdd_cumul
  FROM heat
  WINDOW w AS (PARTITION BY station ORDER BY date),
         w7 AS (PARTITION BY station ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING),
         w3 AS (PARTITION BY station ORDER BY date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING),
         wy AS (PARTITION BY station, year ORDER BY date
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
complete AS (
  SELECT * FROM features WHERE temp_roll7 IS NOT NULL AND wind_roll7 IS NOT NULL
     AND temperature IS NOT NULL AND wind IS NOT NULL AND precip_roll7 IS NOT NULL
     AND pollen_a_mean3 IS NOT NULL AND pollen_b_mean3 IS NOT NULL)
"""


def class3(x: str) -> str:
    return f"CASE WHEN {x} <= 30 THEN 0 WHEN {x} <= 80 THEN 1 ELSE 2 END"


# Risk class of the next day; the last day of a station has none.
TARGETS = FEATURES + f""",
shifted AS (
  SELECT *, lead({class3("pollen_a")}) OVER w AS risk_pollen_a_next,
         lead({class3("pollen_b")}) OVER w AS risk_pollen_b_next
  FROM features WINDOW w AS (PARTITION BY station ORDER BY date)),
labelled AS (
  SELECT s.* FROM shifted s JOIN complete c ON s.station = c.station AND s.date = c.date
  WHERE s.risk_pollen_a_next IS NOT NULL)
"""
